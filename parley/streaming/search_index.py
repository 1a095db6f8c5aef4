"""Incremental index maintenance: a stream of dirty entities replaces the buckets that they touch, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.kept_index import KeptIndex


class IndexMaintainer:
    """Keeps an index in step with a source table.

    Dirty rows are (id, generation, removed). The latest generation of an id
    counts in a batch. The index itself holds the number of the last batch, so a
    maintainer that starts anew goes on where the last one stopped, and a batch
    that is replayed after its manifest was written changes nothing.
    """

    def __init__(self, index: KeptIndex, source: Callable[[], DataFrame]):
        self.index, self.source = index, source

    def apply(self, dirty: DataFrame, batch_id: int) -> None:
        latest = dirty.groupBy("id").agg(F.max_by("removed", "generation").alias("removed"))
        changed = self.source().join(latest.where("not removed").select("id"), "id", "left_semi")
        self.index.update(changed, latest.select("id"), batch_id)

    def follow(self, dirty: DataFrame, checkpoint: str):
        return dirty.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
