"""Live queries: a query runs again when a table that it reads changes, and listeners get what is new.

Changes arrive as a stream of (table, seq). Each micro-batch is one commit:
its tables are coalesced, the subscriptions that depend on any of them run once
as a batch query, and a result equal to the last one is not sent again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dependencies(df: DataFrame) -> set[str]:
    """The folders or files that a query reads, from its plan: equal for queries over the same tables."""
    return {f.rsplit("/part-", 1)[0] if "/part-" in f else f for f in df.inputFiles()}


@dataclass
class Subscription:
    """One query, the tables it depends on, its listeners, and the digest of its last result."""

    query: Callable[[], DataFrame]
    tables: frozenset[str]
    listeners: list[Callable[[DataFrame], None]] = field(default_factory=list)
    seen: tuple | None = None
    since: int = -1


class LiveQueries:
    """Subscriptions over named tables; equal (name, tables) share one query and one run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.active = spark, {}

    def subscribe(self, name: str, query: Callable[[], DataFrame], tables: set[str], listener: Callable[[DataFrame], None], seq: int = -1) -> Callable[[], None]:
        """Runs the query once for its first result, ignoring changes up to seq; the result ends the subscription when called."""
        sub = self.active.setdefault((name, frozenset(tables)), Subscription(query, frozenset(tables), since=seq))
        sub.listeners.append(listener)
        self._refresh(sub, [listener], force=True)

        def end() -> None:
            if listener in sub.listeners:
                sub.listeners.remove(listener)
            if not sub.listeners:
                self.active.pop((name, frozenset(tables)), None)

        return end

    def _refresh(self, sub: Subscription, to: list, force: bool = False) -> None:
        df = sub.query()
        digest = tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())  # one row, not the result
        if not force and digest == sub.seen:
            return
        sub.seen = digest
        for listener in list(to):
            try:
                listener(df)
            except Exception:  # a listener that fails is detached, the others go on
                sub.listeners.remove(listener)

    def changed(self, tables: set[str], seq: int) -> int:
        """One commit: every dependent subscription runs once; how many ran."""
        due = [s for s in self.active.values() if s.tables & tables and seq > s.since]
        for sub in due:
            sub.since = seq
            self._refresh(sub, sub.listeners)
        return len(due)

    def follow(self, changes: DataFrame, checkpoint: str):
        """Follows a stream of (table, seq): a micro-batch is one commit."""

        def commit(batch: DataFrame, _: int) -> None:
            r = batch.groupBy("table").agg(F.max("seq").alias("seq")).collect()  # a row for each table
            if r:
                self.changed({x["table"] for x in r}, max(x["seq"] for x in r))

        return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
