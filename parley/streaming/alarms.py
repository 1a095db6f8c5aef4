"""Alarms for activity that goes on: timers in event time, one quiet spell a key after an alarm, cancelled by a stop.

Rows are (key, ts, action): `start` or `stop`. A start begins to track a key that
is neither tracked nor quiet, under a new generation; a stop ends tracking; a key
that is still tracked `after` its start gives an alarm at that moment, and is
quiet from then on for `quiet`. A row at the very moment of a deadline comes
after it; of rows at one moment stops come first.

The stream holds what it must know of a key: the deadline with its generation,
the last alarm, and the rows that the watermark has not passed, so that rows in
any order give the same alarms. Event-time timers wake a key for its next row
and for its deadline; a timer of an older generation finds another deadline and
does nothing. Rows that come after the watermark and its batch are dropped by
Spark, and an alarm once given stays; a key without rows, deadline and quiet spell has no state.

The batch form reads sorted rows of a partition in one pass and holds one key's
deadline and alarm, however many rows the key has.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds of activity before an alarm, and of quiet after one.
AFTER_MS, QUIET_MS = 15_000, 600_000

ALARM = "key string, since_ms long, fired_ms long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State with timers and several columns a key, for streams that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Tracker:
    """One key: its deadline, the start that it belongs to, and when the key last gave an alarm."""

    def __init__(self, after: int = AFTER_MS, quiet: int = QUIET_MS, deadline: int | None = None, since: int | None = None, fired: int | None = None):
        self.after, self.quiet, self.deadline, self.since, self.fired = after, quiet, deadline, since, fired

    def due(self, now: int) -> list[tuple[int, int]]:
        """The alarm (since, moment) whose deadline `now` has reached."""
        if self.deadline is None or self.deadline > now:
            return []
        self.fired, self.deadline = self.deadline, None
        return [(self.since, self.fired)]

    def row(self, ts: int, action: str) -> list[tuple[int, int]]:
        """The alarms due before a row, and what the row changes."""
        out = self.due(ts)
        if action == "stop":
            self.deadline = None
        elif self.deadline is None and (self.fired is None or ts - self.fired >= self.quiet):
            self.deadline, self.since = ts + self.after, ts
        return out


def _order(action: str) -> int:
    return 0 if action == "stop" else 1


class _Alarms(StatefulProcessor):
    def __init__(self, after: int, quiet: int):
        self.after, self.quiet = after, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "deadline long, since long, fired long")
        self.waiting = handle.getListState("waiting", "ts long, action string")

    def _tracker(self) -> Tracker:
        if not self.held.exists():
            return Tracker(self.after, self.quiet)
        deadline, since, fired = self.held.get()
        return Tracker(self.after, self.quiet, deadline, since, fired)

    def _wake(self, moments: list[int]) -> None:
        """One timer, for the next moment at which something is to be done."""
        have = set(_timers(self.handle))
        want = {min(moments)} if moments else set()
        for t in have - want:
            self.handle.deleteTimer(t)
        for t in want - have:
            self.handle.registerTimer(t)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for ts, action in zip(frame["ts"].astype("datetime64[ms]").astype("int64"), frame["action"], strict=True):
                self.waiting.appendValue((int(ts), action))
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _settled(self, key: Any, watermark: int, expired: int | None = None) -> Iterator[pd.DataFrame]:
        """What is certain by now: rows that the watermark has passed, in order, and a deadline before it."""
        tracker, rows = self._tracker(), sorted(((r[0], r[1]) for r in self.waiting.get()), key=lambda r: (r[0], _order(r[1]))) if self.waiting.exists() else []
        done = [r for r in rows if r[0] < watermark]
        rest = rows[len(done) :]
        out = [a for ts, action in done for a in tracker.row(ts, action)]
        out += tracker.due(watermark - 1)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        over = tracker.fired is not None and tracker.fired + self.quiet <= watermark
        if tracker.deadline is None and over and not rest:
            self.held.clear()
            moments = []
        else:
            self.held.update((tracker.deadline, tracker.since, tracker.fired))
            moments = [rest[0][0] + 1] if rest else []
            moments += [tracker.deadline + 1] if tracker.deadline is not None else []
            moments += [tracker.fired + self.quiet] if tracker.fired is not None and not over and not moments else []
        self._wake([max(m, watermark + 1) for m in moments])
        if out:
            yield pd.DataFrame({"key": key[0], "since_ms": [a[0] for a in out], "fired_ms": [a[1] for a in out]})


def _timers(handle: StatefulProcessorHandle) -> list[int]:
    return [int(t) for t in handle.listTimers()]


def stream_alarms(rows: DataFrame, delay: str, after: int = AFTER_MS, quiet: int = QUIET_MS) -> DataFrame:
    """Alarms of a stream of (key, ts, action); start it inside `keyed_state`. Rows may be late by `delay`."""
    own = rows.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "action").withWatermark("ts", delay)
    return own.groupBy("key").transformWithStateInPandas(_Alarms(after, quiet), ALARM, "append", "eventTime")


def batch_alarms(rows: DataFrame, after: int = AFTER_MS, quiet: int = QUIET_MS, until: int | None = None) -> DataFrame:
    """Alarms of a bounded table of (key, ts, action); deadlines up to `until`, or all, count as reached."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    own = rows.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("action").isin("start", "stop")).select(F.col("key").cast("string").alias("key"), ms.alias("ms"), "action")
    dealt = own.repartition("key").sortWithinPartitions("key", "ms", F.when(F.col("action") == "stop", 0).otherwise(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tracker = None, Tracker(after, quiet)
        end = until if until is not None else (1 << 62)
        for batch in batches:
            out = []
            for key, ts, action in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    out += [(last, *a) for a in tracker.due(end)] if last is not None else []
                    last, tracker = key, Tracker(after, quiet)
                out += [(key, *a) for a in tracker.row(ts, action)]
            yield _alarm_batch(out)
        if last is not None:
            yield _alarm_batch([(last, *a) for a in tracker.due(end)])

    return dealt.mapInArrow(run, ALARM)


def _alarm_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "since_ms", "fired_ms"])
