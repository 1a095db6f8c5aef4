"""Cosine similarity as built-in expressions, best partners, and mutual best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least score of a match, and how far the runner-up has to be behind.
LEAST_SCORE, MARGIN = 0.62, 0.08
#: Exemplars that are held beside a row in one list.
MOST_EXEMPLARS = 4096


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays within [-1, 1]; null where lengths differ, or one is empty or zero."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(fits, F.greatest(F.least(_dot(a, b) / norms, F.lit(1.0)), F.lit(-1.0)))


def centroids(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, centroid): the mean vector of each group, summed by position so that no group is gathered."""
    parts = vectors.select(*by, F.posexplode("embedding").alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(*by, F.transform("v", lambda e: e["x"]).alias("centroid"))


def scores(samples: DataFrame, exemplars: DataFrame, domain: list[str]) -> DataFrame:
    """(speaker, human, score): the best cosine of each pair within a domain; exemplars are few, so Spark broadcasts them where their size allows."""
    j = samples.select("speaker", *domain, F.col("embedding").alias("_a")).join(exemplars.select("human", *domain, F.col("embedding").alias("_b")), domain)
    return j.select("speaker", "human", cosine("_a", "_b").alias("score")).where("score is not null").groupBy("speaker", "human").agg(F.max("score").alias("score"))


def best_of(vectors: DataFrame, exemplars: DataFrame, k: int) -> DataFrame:
    """The k best exemplars (label, centroid) of each vector, as rows with label and score, ties by label.

    Exemplars are counted and, up to MOST_EXEMPLARS, held beside each row as one
    list, so nothing is shuffled. More are dealt into lists of that many; each
    list keeps its best k for a vector, and these meet by vector.
    """
    n = exemplars.count()
    dealt = exemplars.withColumn("_g", F.pmod(F.xxhash64("label"), F.lit(-(-n // MOST_EXEMPLARS) or 1)))
    lists = dealt.groupBy("_g").agg(F.collect_list(F.struct("label", "centroid")).alias("_x")).drop("_g")
    held = vectors.withColumn("_key", F.monotonically_increasing_id()) if n > MOST_EXEMPLARS else vectors
    near = F.filter(F.transform("_x", lambda x: F.struct((-cosine(F.col("embedding"), x["centroid"])).alias("s"), x["label"].alias("label"))), lambda x: x["s"].isNotNull())
    best = held.crossJoin(F.broadcast(lists)).withColumn("_b", F.slice(F.array_sort(near), 1, k)).drop("_x")
    if n > MOST_EXEMPLARS:
        best = best.groupBy("_key").agg(*[F.first(c).alias(c) for c in vectors.columns], F.slice(F.array_sort(F.flatten(F.collect_list("_b"))), 1, k).alias("_b"))
    return best.select(*vectors.columns, F.explode("_b").alias("_b")).select(*vectors.columns, F.col("_b.label").alias("label"), (-F.col("_b.s")).alias("score"))


def mutual_best(pairs: DataFrame, least: float = LEAST_SCORE, margin: float = MARGIN) -> DataFrame:
    """(speaker, human, score): pairs that are best for both sides, good enough, and ahead of both sides' runners-up by the margin."""

    def ranked(key: str, other: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.col("score").desc(), other)
        r = pairs.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
        best = r.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col(other))).alias(other), F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("_second"))
        return best.where((F.col("score") >= least) & (F.col("_second").isNull() | (F.col("score") - F.col("_second") >= margin))).select(key, other, "score")

    return ranked("speaker", "human").join(ranked("human", "speaker").drop("score"), ["speaker", "human"])
