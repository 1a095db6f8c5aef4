"""Levels, hangover, smoothing, peaks and speech sessions over the value series of each user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.operators import signal as G
from parley.plans.catalog import query
from parley.sources.tables import load
from parley.streaming.alarms import batch_alarms

_SERIES = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"


def _series(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf, "events").withColumn("i", F.row_number().over(w) - 1)


@query(
    "level_windows",
    f"SELECT user_id, (i // 20)::BIGINT AS win, round(sqrt(avg(value * value)), 6) AS rms, max(abs(value)) AS peak, round(avg((value <> 0)::INT), 6) AS nonzero, count(*) AS n, round(20 * log10(greatest(sqrt(avg(value * value)), 1e-9)), 6) AS level FROM {_SERIES} GROUP BY 1, 2",
    covers="a_rms_peak s_tumbling_level sf_dbfs",
)
def level_windows(spark, sf):
    r = G.level_windows(_series(spark, sf), ["user_id"], "i", "value", 20)
    return r.select("user_id", "win", F.round("rms", 6).alias("rms"), "peak", F.round("nonzero", 6).alias("nonzero"), "n", F.round(G.dbfs(F.col("rms")), 6).alias("level"))


@query("hangover", "SELECT event_id, max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS held FROM events", covers="s_hangover")
def hangover(spark, sf):
    return G.hangover(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "held")


@query("silence_gate", f"SELECT user_id, win FROM (SELECT user_id, (i // 20)::BIGINT AS win, sqrt(avg(value * value)) AS rms FROM {_SERIES} GROUP BY 1, 2) WHERE rms >= 35", covers="s_silence_gate")
def silence_gate(spark, sf):
    return G.level_windows(_series(spark, sf), ["user_id"], "i", "value", 20).where("rms >= 35").select("user_id", "win")


@query(
    "ewma",
    f"""WITH RECURSIVE s AS (SELECT user_id, i, value FROM {_SERIES}),
    r AS (SELECT user_id, i, value AS x FROM s WHERE i = 0 UNION ALL SELECT s.user_id, s.i, 0.8::DOUBLE * x + 0.2::DOUBLE * value FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
    SELECT user_id, count(*) AS n, round(arg_max(x, i), 6) AS last FROM r GROUP BY 1""",
    covers="w_ewma",
)
def ewma(spark, sf):
    return G.smoothed(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "n", F.round("last", 6).alias("last"))


@query(
    "peaks",
    """WITH e AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, abs(value) AS v FROM events),
    c AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1),
    n AS (SELECT event_type, n, min(k) AS k FROM c, range(0, 40) r(k) WHERE n // (1::BIGINT << k) < 200 GROUP BY 1, 2),
    b AS (SELECT event_type, n, 1::BIGINT << k AS size, i // (1::BIGINT << k) AS block, max(v) AS peak FROM e JOIN n USING (event_type) GROUP BY ALL),
    s AS (SELECT *, greatest(ceil(n / size::DOUBLE) / 100.0, 1.0) AS step, least(ceil(n / size::DOUBLE), 100) AS buckets FROM b)
    SELECT event_type, u.bucket::BIGINT AS bucket, max(peak) AS peak FROM s, range(0, 100) u(bucket) WHERE u.bucket < buckets AND floor(u.bucket * step) <= block AND ceil((u.bucket + 1) * step) > block GROUP BY 1, 2""",
    covers="s_peaks",
)
def peaks(spark, sf):
    """The outline of each type's values in order, in 100 buckets at most."""
    w = Window.partitionBy("event_type").orderBy("event_id")
    e = load(spark, sf, "events").select("event_type", "value", (F.row_number().over(w) - 1).alias("i"))
    return G.peaks(e, ["event_type"], "i", "value", 100)


@query("channel_lags", None, covers="s_gcc_phat")
def channel_lags(spark, sf):
    e = _series(spark, sf)
    w = Window.partitionBy("user_id").orderBy("i")
    e = e.withColumn("b", F.coalesce(F.lag("value", 5).over(w), F.lit(0.0)))
    return G.lags(e, ["user_id"], "i", "value", "b", 20)


@query(
    "speech_sessions",
    f"""WITH l AS (SELECT user_id, i * 100 AS t, CASE WHEN value >= 50 THEN 1 WHEN value < 15 THEN 0 END AS l FROM {_SERIES}),
    s AS (SELECT user_id, t FROM (SELECT *, last_value(l IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM l) WHERE s = 1),
    g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 600 THEN 0 ELSE 1 END AS new FROM s),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
    SELECT user_id, session, min(t) AS "start", max(t) AS "end" FROM r GROUP BY 1, 2 HAVING max(t) - min(t) >= 90""",
    covers="s_speech_session",
)
def speech_sessions(spark, sf):
    e = _series(spark, sf).withColumn("t", F.col("i").cast("long") * 100)
    return G.speech_sessions(e, ["user_id"], "t", "value", 50, 15)


@query(
    "cooldown",
    """WITH RECURSIVE e AS (
      SELECT user_id, epoch_us(ts) // 1000 AS t, event_type = 'error' AS stops, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type = 'error' DESC, event_id) AS i
      FROM events WHERE event_type IN ('click', 'view', 'error')),
    r AS (
      SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS deadline, NULL::BIGINT AS since, NULL::BIGINT AS fired, NULL::BIGINT AS o_since, NULL::BIGINT AS o_fired FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT user_id, i,
        CASE WHEN stops THEN NULL WHEN due THEN CASE WHEN t - deadline >= 86400000 THEN t + 21600000 END WHEN deadline IS NOT NULL THEN deadline WHEN fired IS NULL OR t - fired >= 86400000 THEN t + 21600000 END,
        CASE WHEN NOT stops AND CASE WHEN due THEN t - deadline >= 86400000 WHEN deadline IS NULL THEN fired IS NULL OR t - fired >= 86400000 ELSE FALSE END THEN t ELSE since END,
        CASE WHEN due THEN deadline ELSE fired END, CASE WHEN due THEN since END, CASE WHEN due THEN deadline END
      FROM (SELECT e.user_id, e.i, e.t, e.stops, r.deadline, r.since, r.fired, coalesce(r.deadline <= e.t, FALSE) AS due FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
    SELECT user_id, o_since AS since_ms, o_fired AS fired_ms FROM r WHERE o_fired IS NOT NULL
    UNION ALL SELECT user_id, since, deadline FROM r WHERE deadline IS NOT NULL AND i = (SELECT max(i) FROM e WHERE e.user_id = r.user_id)""",
    covers="s_cooldown",
)
def cooldown(spark, sf):
    """Users who go on for six hours without an error give an alarm, one in a day; tests hold the stream with its timers to this fold."""
    action = F.when(F.col("event_type") == "error", "stop").otherwise("start").alias("action")
    e = load(spark, sf, "events").where("event_type in ('click', 'view', 'error')").select(F.col("user_id").cast("string").alias("key"), "ts", action)
    return batch_alarms(e, after=21_600_000, quiet=86_400_000).select(F.col("key").cast("long").alias("user_id"), "since_ms", "fired_ms")
