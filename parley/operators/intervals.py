"""Intervals: merging into runs, subtracting other intervals, and the longest spans of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: Sequence[str], start: Column, end: Column, gap: int, ties: Sequence[str] = ()) -> DataFrame:
    """(keys, run, start, end, n): intervals of a key merge while the next starts at most `gap` after the latest end so far.

    `run` numbers the runs of each key. One sort by key serves both windows.
    """
    rows = df.select(*keys, start.alias("start"), end.alias("end"), *ties)
    w = Window.partitionBy(*keys).orderBy("start", "end", *ties)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0))
    numbered = opened.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def alone(df: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """(keys, owner, start, end): what is left of each owner's intervals after those of all other owners of the key are subtracted.

    owner is a whole number, and the intervals of one owner do not overlap (merge
    them with `runs` first). No pairs of intervals are formed: starts and ends
    are swept in order with a running sum of open intervals and of their owners;
    where one is open, the second sum is its owner.
    """
    rows = df.where("end > start")
    ends = rows.select(*keys, owner, F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(rows.select(*keys, owner, F.col("end").alias("at"), F.lit(-1).alias("d")))
    steps = ends.groupBy(*keys, "at").agg(F.sum("d").alias("d"), F.sum(F.col("d") * F.col(owner)).alias("o"))
    w = Window.partitionBy(*keys).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.select(*keys, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("d").over(so_far).alias("open"), F.sum("o").over(so_far).alias(owner))
    pieces = swept.where("open = 1 and end is not null")
    return runs(pieces, [*keys, owner], F.col("start"), F.col("end"), 0).select(*keys, owner, "start", "end")


def longest(df: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """The n longest intervals of each group, earlier ones first among equals, with rank."""
    w = Window.partitionBy(*keys).orderBy((F.col("end") - F.col("start")).desc(), "start")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def centred(start: Column, end: Column, most: int) -> tuple[Column, Column]:
    """An interval cut to its middle `most`."""
    cut = F.greatest((end - start) - most, F.lit(0))
    return start + F.floor(cut / 2).cast("long"), F.least(end, start + F.floor(cut / 2).cast("long") + most)


#: Fixed values, in milliseconds: gap within which words are one run, length of a span at least and at most; spans of a speaker.
RUN_GAP, LEAST_SPAN, MOST_SPAN, SPANS = 400, 1_500, 10_000, 3


def speaker_spans(words: DataFrame, keys: Sequence[str], speaker: str) -> DataFrame:
    """(keys, speaker, start, end, rank, quality): where each speaker of a key is heard alone, the SPANS longest stretches.

    words: (keys, speaker, start_ms, end_ms). Words near each other make runs; what
    other speakers of the key say is cut out; what is left is cut to its middle
    MOST_SPAN and counts from LEAST_SPAN on; quality is its share of MOST_SPAN.
    Words that last no time are left out; a null speaker is one of its own.
    """
    spoken = words.where("end_ms > start_ms").withColumn("_owner", F.coalesce(F.col(speaker).cast("long"), F.lit(-1)))
    own = runs(spoken, [*keys, "_owner"], F.col("start_ms"), F.col("end_ms"), RUN_GAP).select(*keys, "_owner", "start", "end")
    start, end = centred(F.col("start"), F.col("end"), MOST_SPAN)
    cut = alone(own, keys, "_owner").select(*keys, "_owner", start.alias("start"), end.alias("end")).where(F.col("end") - F.col("start") >= LEAST_SPAN)
    top = longest(cut, [*keys, "_owner"], SPANS)
    return top.select(*keys, F.when(F.col("_owner") >= 0, F.col("_owner")).alias(speaker), "start", "end", "rank", F.least((F.col("end") - F.col("start")) / F.lit(float(MOST_SPAN)), F.lit(1.0)).alias("quality"))
