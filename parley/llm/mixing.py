"""Mixing sources to target weights by Pareto order sampling.

A source's target in words is its share of all words by weight, at most MOST
times its own size; what exceeds that is shared again among the others. Whole
copies of every document come first; for the rest, a document of size s gets
the inclusion odds of p = f * s**TEMPER (scaled so that the expected words are
right, at most 1), its rank is its random odds u / (1 - u) divided by p / (1 -
p), and documents are taken by rank up to the words that are left. The one
document that closes the remaining gap best is taken as well. u is a hash of
the row, so reruns agree.

The cut is found without sorting a source: words are summed by bucket of rank,
and only the bucket in which the target falls is put in order.

Defined results: null text has size 0 and is never taken; a null source is a
source of its own, last in order; rows that repeat doc_id and text are taken
together; ties in rank are in order of doc_id and text; a very long text counts
whole; an empty table gives an empty mix. Columns that have a new one's name
stay, and the new one gets an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm._shared import checkpointed, row_key, unused

#: A document is taken at most so many times.
MOST = 3
TEMPER = 0.5
BUCKETS = 8192
#: Sources up to which their plan is broadcast (each takes some hundred bytes); beyond, it goes to SALTS parts of each source's rows.
BROADCAST_SOURCES, SALTS = 50_000, 64

_SIZE = r"[^\x20\x09-\x0D]+"


def _source() -> Column:
    """Sources as a key that is never null and sorts by code point, null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))


def planned(totals: DataFrame, weights: Sequence[float], most: int = MOST) -> DataFrame:
    """Adds target to the totals (src, words, ...) of sources: shares by weight of the sum of all words, none above most times its own.

    Sources are numbered by range partitions in order of src. What the capped
    ones leave is shared again, in a grouped sum for each round, until no other
    is above its cap.
    """
    dealt = totals.repartitionByRange("src").withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy(F.col("src").cast("binary")))))
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, base = 0, []
    for part in sorted(sizes):
        base.append(F.when(F.col("part") == part, F.lit(before)))
        before += sizes[part]
    place = (F.coalesce(*base, F.lit(0)) + F.col("row") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rows, level, capped = dealt.withColumn("weight", weight), 0.0, -1
    all_words = totals.agg(F.sum("words")).first()[0] or 0
    while True:
        over = F.col("weight") * level > most * F.col("words")
        n, given, left = rows.agg(F.count_if(over), F.sum(F.when(over, most * F.col("words"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not left:
            break
        capped, level = n, (all_words - (given or 0)) / left
    return rows.withColumn("target", F.least(F.col("weight") * level, most * F.col("words").cast("double"))).drop("part", "row", "weight")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST, temper: float = TEMPER, seed: int = 1) -> DataFrame:
    """Adds size, source_size, target, copies and taken (copies * size) to documents (doc_id, text, source)."""
    size = F.coalesce(F.regexp_count("text", F.lit(_SIZE)), F.lit(0)).cast("long")
    key = [_source().alias("src"), *row_key()]
    rows = checkpointed(docs.select(*key, size.alias("size")))
    totals = rows.groupBy("src").agg(F.sum("size").alias("words"), F.sum(F.pow("size", F.lit(1 + temper))).alias("power"))
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int")
    rest = F.col("target") - F.col("whole") * F.col("words")
    plan = planned(totals, weights, most).withColumn("whole", whole).withColumn("rest", rest).withColumn("rate", F.when(F.col("power") > 0, F.col("rest") / F.col("power")).otherwise(0.0))
    plan = checkpointed(plan.select("src", F.col("words").alias("source_size"), "target", "whole", "rest", "rate"))
    few = plan.count() <= BROADCAST_SOURCES

    def by_source(df: DataFrame, table: DataFrame) -> DataFrame:
        """df with the columns of a table of one row for each source at most."""
        if few:
            return df.join(F.broadcast(table), "src")
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return df.withColumn("salt", F.pmod(F.xxhash64("k_id", "k_text"), F.lit(SALTS)).cast("int")).join(salted, ["src", "salt"]).drop("salt")

    def ranked(df: DataFrame) -> DataFrame:
        """rank: random odds by inclusion odds; slot: its bucket. Documents that are certain have rank 0."""
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k_id", "k_text"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
        p = F.least(F.col("rate") * F.pow("size", F.lit(temper)), F.lit(1.0))
        df = df.withColumn("rank", F.when(p > 0, u / (1 - u) * (1 - p) / p))
        return df.withColumn("slot", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))

    lots = ranked(by_source(rows, plan).where("size > 0 and rest > 0"))
    by_slot = lots.groupBy("src", "rest", "slot").agg(F.sum("size").alias("words"))
    upto = by_slot.withColumn("upto", F.sum("words").over(Window.partitionBy("src").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))
    edge = upto.where("upto > rest").groupBy("src").agg(F.min(F.struct("slot", (F.col("upto") - F.col("words")).alias("before"))).alias("e")).select("src", F.col("e.slot").alias("edge"), F.col("e.before").alias("before"))
    edge = checkpointed(edge)
    order = Window.partitionBy("src").orderBy("rank", "k_id", "k_text")
    inside = by_source(lots, edge).where("slot = edge").withColumn("upto", F.col("before") + F.sum("size").over(order))
    last = inside.where("upto <= rest").groupBy("src").agg(F.max(F.struct("rank", "k_id", "k_text", "upto")).alias("last"))
    cut = checkpointed(edge.join(last, "src", "left").select("src", "edge", F.col("last.rank").alias("l_rank"), F.col("last.k_id").alias("l_id"), F.col("last.k_text").alias("l_text"), F.coalesce("last.upto", "before").alias("got")))

    def before_cut() -> Column:
        tie = F.struct("rank", "k_id", "k_text") <= F.struct(F.col("l_rank").alias("rank"), F.col("l_id").alias("k_id"), F.col("l_text").alias("k_text"))
        return F.coalesce((F.col("slot") < F.col("edge")) | ((F.col("slot") == F.col("edge")) & F.col("l_rank").isNotNull() & tie), F.col("edge").isNull())

    gap = F.col("rest") - F.col("got")
    after = by_source(lots, cut).where(~before_cut()).where(F.abs(gap - F.col("size")) < gap)
    closing = after.groupBy("src").agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("miss"), "rank", "k_id", "k_text")).alias("c"))
    closing = closing.select("src", F.col("c.k_id").alias("c_id"), F.col("c.k_text").alias("c_text"))
    cut = checkpointed(plan.join(cut, "src", "left").join(closing, "src", "left"))

    names = {n: unused(docs, n) for n in ("size", "source_size", "target", "copies", "taken")}
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = ranked(by_source(docs.select(held, *key, size.alias("size")), cut))
    closes = (F.col("k_id") == F.col("c_id")) & (F.col("k_text") == F.col("c_text"))
    drawn = (F.col("size") > 0) & (F.col("rest") > 0) & F.col("rank").isNotNull() & (before_cut() | F.coalesce(closes, F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("whole") + drawn.cast("int")).otherwise(0)
    new = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "taken": F.col("size") * copies}
    return out.select("row.*", *[c.alias(names[n]) for n, c in new.items()])


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """The mix itself: each document as often as it is taken; columns as they were."""
    out = mix(docs, weights)
    copies = out.columns[-2]
    return out.where(F.col(copies) > 0).withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*docs.columns)
