"""Alarms: the stream with late and cancelled rows equals the batch fold, and both equal a plain reading of the rules."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from parley.operators.graph import shared_folder
from parley.streaming import alarms as A

SCHEMA = "key string, ms long, action string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("key", F.timestamp_millis("ms").alias("ts"), "action")


def brute(rows, after=A.AFTER_MS, quiet=A.QUIET_MS):
    out = set()
    for key in {r[0] for r in rows}:
        own = sorted(((t, a != "stop", a) for k, t, a in rows if k == key))
        deadline = fired = since = None
        for t, _, action in [*own, (1 << 61, True, "none")]:
            if deadline is not None and deadline <= t:
                out.add((key, since, deadline))
                deadline, fired = None, deadline
            if action == "stop":
                deadline = None
            elif action == "start" and deadline is None and (fired is None or t - fired >= quiet):
                deadline, since = t + after, t
    return out


def told(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_rules(spark):
    rows = [
        ("goes on", 0, "start"), ("stopped", 0, "start"), ("stopped", 14_999, "stop"), ("at the moment", 0, "start"), ("at the moment", 15_000, "stop"),
        ("again", 0, "start"), ("again", 20_000, "start"), ("again", 614_999, "start"), ("again", 615_000, "start"), ("restarted", 0, "start"), ("restarted", 10_000, "stop"), ("restarted", 12_000, "start"),
        ("twice", 0, "start"), ("twice", 9_000, "start"), ("both", 5, "stop"), ("both", 5, "start"),
    ]
    got = told(A.batch_alarms(frame(spark, rows)))
    assert got == brute(rows)
    assert got == {("goes on", 0, 15_000), ("at the moment", 0, 15_000), ("again", 0, 15_000), ("again", 615_000, 630_000), ("restarted", 12_000, 27_000), ("twice", 0, 15_000), ("both", 5, 15_005)}
    assert told(A.batch_alarms(frame(spark, rows), until=20_000)) == {x for x in got if x[2] <= 20_000}
    assert A.batch_alarms(frame(spark, rows).where("false")).count() == 0
    assert A.batch_alarms(frame(spark, [(None, 1, "start"), ("x", None, "start"), ("x", 1, "pause")])).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Rows come in three batches, out of order within the delay; timers fire in batches without rows of their key."""
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(6)}", t, rng.choice(["start", "start", "stop"])) for t in sorted(rng.randrange(4_000_000) for _ in range(240))]
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(40_000))
    batches = [late[:90], late[90:170], [*late[170:], ("end", 9_000_000, "stop")], [("end", 9_000_001, "stop")]]
    schema = "key string, ts timestamp, action string"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        frame(spark, batch).coalesce(1).write.mode("append").parquet(folder)
        with A.keyed_state(spark):
            shared_folder(spark)
            stream = A.stream_alarms(spark.readStream.schema(schema).parquet(folder), "60 seconds")
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = told(spark.read.schema(A.ALARM).parquet(out))
    assert got == brute(rows) and len(got) > 20


def test_rows_later_than_the_watermark_change_nothing(spark, tmp_path):
    schema = "key string, ts timestamp, action string"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([("a", 1_000, "start"), ("b", 500_000, "stop")], [("b", 500_001, "stop")], [("a", 5_000, "stop"), ("b", 500_002, "stop")], [("b", 900_000, "stop")]):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(folder)
        with A.keyed_state(spark):
            stream = A.stream_alarms(spark.readStream.schema(schema).parquet(folder), "60 seconds")
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert told(spark.read.schema(A.ALARM).parquet(out)) == {("a", 1_000, 16_000)}
