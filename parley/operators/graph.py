"""Connected components of an edge list, and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, set here only where it is unset."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        local = context.master.startswith("local") and not context.master.startswith("local-cluster")
        path = tempfile.mkdtemp(prefix="parley-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Edges from which hubs are looked for; below, even one node with all edges is no load for a task.
HUB_EDGES = 100_000
#: A hub has at least this part of all edges, so there are at most twice as many hubs.
HUB_SHARE = 1_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id reaches over edges (a, b).

    Alternates large-star and small-star steps until every id has one edge, to
    an id without one. Every step is a grouped minimum, which is combined before
    the shuffle, and a join. Nodes with a thousandth of all edges or more, of
    which there can be two thousand, get their minimum by broadcast, so that no
    node's edges meet in one task; the lineage is cut each time. Loops and
    repeated edges change nothing.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while (state := _state(e))[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, state[1], own=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, state[1]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _with_least(pairs: DataFrame, edges: int, own: bool = False) -> DataFrame:
    """(u, v, m): m is the least v of u, or u itself where that counts and is less."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", (F.least("u", "m") if own else F.col("m")).alias("m"), "n")
    if edges < HUB_EDGES:
        return pairs.join(low.drop("n"), "u")
    low = checkpointed(low)
    hub = F.col("n") * HUB_SHARE >= edges
    hubs, others = (low.where(which).drop("n") for which in (hub, ~hub))
    rest = pairs.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(others, "u")
    return pairs.join(F.broadcast(hubs), "u").unionByName(rest)


def _state(e: DataFrame) -> tuple[bool, int]:
    """(whether some id below has several edges or is also above, the number of edges)."""
    below = e.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    above = e.select(F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    ends = below.unionByName(above).groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    odd, edges = ends.agg(F.count_if(F.expr("below > 1 or below = 1 and above = 1")), F.sum("below")).first()
    return odd > 0, edges or 0
