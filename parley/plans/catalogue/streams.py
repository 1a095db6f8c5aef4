"""Streams run to their end, and their batch equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.plans.catalog import query
from parley.sources.tables import load
from parley.streaming import live_words as L
from parley.streaming.bounded import run_to_end, table_stream


@query(
    "stream_windows",
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    covers="src_sql",
)
def stream_windows(spark, sf):
    """A windowed aggregate with a watermark over a file stream; state holds a row for each type and window that the watermark has not passed."""
    e = table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    w = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return run_to_end(w.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total")), "update", ["day", "event_type"])


def messages(spark, sf, repeated=True):
    """Messages of a live transcript from turns: a final with the turn's words, a partial before it, a flush at the end; some finals arrive twice."""
    c = load(spark, sf, "conversations").select(F.col("conv_id").alias("transcript"), (F.col("role") == "assistant").cast("int").alias("channel"), F.col("turn").alias("seq"), F.split(F.trim("text"), r"\s+").alias("w"))
    at = lambda i: (F.col("seq") * 900_000 + i * 300).cast("long")
    words = F.transform("w", lambda x, i: F.struct(F.concat(F.when((i % 5) == 4, "").otherwise(" "), x).alias("text"), at(i).alias("start_ms"), (at(i) + 250).alias("end_ms")))
    final = c.select("transcript", "channel", (F.col("seq") * 3 + 1).alias("seq"), F.lit("final").alias("kind"), F.lit(None).cast("string").alias("job"), words.alias("words"))
    partial = final.select("transcript", "channel", F.col("seq") - 1, F.lit("partial").alias("kind"), "job", F.slice("words", 1, 3).alias("words"))
    again = final.where("transcript % 4 = 0").select("transcript", "channel", F.col("seq") + 1, F.lit("final").alias("kind"), "job", "words")
    end = c.groupBy("transcript", "channel").agg((F.max("seq") * 3 + 3).alias("seq")).select("transcript", "channel", "seq", F.lit("flush").alias("kind"), F.lit(None).cast("string").alias("job"), F.array().cast("array<struct<text:string,start_ms:bigint,end_ms:bigint>>").alias("words"))
    once = final.union(partial).union(end)
    return once.union(again) if repeated else once


@query(
    "live_words",
    r"""WITH t AS (SELECT conv_id AS transcript, (role = 'assistant')::INT AS channel, turn, string_split_regex(trim(text), '\s+') AS w FROM conversations),
    p AS (SELECT transcript, channel, turn, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM t),
    m AS (SELECT *, lag(x) OVER (PARTITION BY transcript, channel ORDER BY turn, i) AS before, lag(turn) OVER (PARTITION BY transcript, channel ORDER BY turn, i) AS bturn FROM p),
    f AS (SELECT transcript, channel, turn, i, x, CASE WHEN i % 5 = 4 AND bturn = turn AND NOT regexp_matches(before, '[.!?]$') THEN 0 ELSE 1 END AS new FROM m)
    SELECT transcript, channel, sum(new)::BIGINT AS words, sum(length(x))::BIGINT AS chars FROM f GROUP BY 1, 2""",
    covers="s_watermark_dedup s_partial_replace s_stitch s_bounds s_flush",
)
def live_words(spark, sf):
    """The batch fold of the same step that the stream runs; tests hold the stream to it."""
    w = L.batch_words(messages(spark, sf))
    return w.groupBy("transcript", "channel").agg(F.count("*").alias("words"), F.sum(F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("chars"))


def handed_off(spark, sf):
    """Messages of turns: what the assistant says is sent off for correction, and turns of more than 20 words come back as one word."""
    m = messages(spark, sf, repeated=False)
    job = F.when((F.col("kind") == "final") & (F.col("channel") == 1), F.get("words", F.lit(0))["start_ms"].cast("string"))
    sent = m.withColumn("job", job)
    fixed = F.array(F.struct(F.lit(" FIXED").alias("text"), F.get("words", F.lit(0))["start_ms"].alias("start_ms"), F.get("words", F.lit(0))["end_ms"].alias("end_ms")))
    back = sent.where((F.size("words") > 20) & F.col("job").isNotNull()).select("transcript", "channel", F.col("seq") + 1, F.lit("correction").alias("kind"), "job", fixed.alias("words"))
    return sent.union(back)


@query(
    "live_corrections",
    r"""WITH t AS (SELECT conv_id AS transcript, (role = 'assistant')::INT AS channel, turn, string_split_regex(trim(text), '\s+') AS w FROM conversations),
    p AS (SELECT transcript, channel, turn, len(w) > 20 AS long, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM t),
    m AS (SELECT *, lag(x) OVER (PARTITION BY transcript, channel ORDER BY turn, i) AS before, lag(turn) OVER (PARTITION BY transcript, channel ORDER BY turn, i) AS bturn FROM p),
    f AS (SELECT * FROM m WHERE NOT (i % 5 = 4 AND bturn = turn AND NOT regexp_matches(before, '[.!?]$'))),
    e AS (SELECT transcript, channel, lead(turn) OVER (PARTITION BY transcript, channel ORDER BY turn, i) AS eturn, lead(long) OVER (PARTITION BY transcript, channel ORDER BY turn, i) AS long FROM f),
    c AS (SELECT transcript, channel, count(*) FILTER (channel = 1 AND len(w) > 20) AS corrected FROM t GROUP BY 1, 2)
    SELECT transcript, channel, count(*) FILTER (channel = 1 AND eturn IS NOT NULL) AS pending, any_value(corrected) AS corrected, count(*) FILTER (channel = 1 AND eturn IS NOT NULL AND NOT long) AS promoted,
    count(*) FILTER (channel = 1 AND eturn IS NOT NULL AND long) AS replaced, count(*) FILTER (channel = 0 OR eturn IS NULL) AS plain FROM e JOIN c USING (transcript, channel) GROUP BY 1, 2""",
    covers="s_corrections s_flush",
)
def live_corrections(spark, sf):
    """How many words were pending, corrected, promoted without a correction, replaced by one, or final at once."""
    w = L.batch_words(handed_off(spark, sf))
    own, none = F.col("replaces") == F.array("id"), F.size("replaces") == 0
    fixed, final = F.col("text") == " FIXED", F.col("state") == "final"
    return w.groupBy("transcript", "channel").agg(
        F.count_if(~final).alias("pending"), F.count_if(fixed).alias("corrected"), F.count_if(final & ~fixed & own).alias("promoted"),
        F.sum(F.when(fixed, F.size("replaces")).otherwise(0)).alias("replaced"), F.count_if(final & ~fixed & none).alias("plain"),
    )


@query(
    "service_words",
    r"""WITH c AS (SELECT conv_id AS transcript, (role = 'assistant')::INT AS channel, turn * 3 AS seq, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM conversations),
    x AS (SELECT transcript, channel, seq, len(regexp_extract_all(s, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+')) AS tokens,
      string_split(regexp_replace(regexp_replace(regexp_replace(s, '([,;:!?)}\]''"])([\p{L}\p{N}])', '\1 \2', 'g'), '\.([\p{Lu}\p{Lt}\p{Lo}\p{Lm}])', '. \1', 'g'), '(^|[^\p{L}\p{N}])\.(\p{Ll})', '\1. \2', 'g'), ' ') AS w FROM c WHERE s <> '')
    SELECT transcript, channel, seq, CASE WHEN transcript % 2 = 0 THEN 'final' ELSE 'partial' END AS kind, len(w)::INT AS words, tokens * 250 - 50 AS end_ms, sha256(array_to_string(w, '|')) AS digest FROM x""",
    covers="src_stream s_assemble",
)
def service_words(spark, sf):
    """A stream of envelopes in JSON, whose tokens are words and signs apart, assembled to words as the transcript spaces them."""
    c = table_stream(spark, sf, "conversations").select(F.col("conv_id").alias("transcript"), (F.col("turn") * 3).alias("seq"), "role", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("s")).where("s <> ''")
    tokens = F.transform(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), 0), lambda t, i: F.struct(t.alias("word"), (i * 0.25).alias("start"), (i * 0.25 + 0.2).alias("end")))
    best = F.array(F.struct(F.col("s").alias("transcript"), tokens.alias("words")))
    channel = (F.col("role") == "assistant").cast("int")
    results = F.to_json(F.struct(F.lit("Results").alias("type"), (F.col("transcript") % 2 == 0).alias("is_final"), F.struct(best.alias("alternatives")).alias("channel"), F.array(channel).alias("channel_index")))
    lines = c.select("transcript", "seq", F.explode(F.array(results, F.lit('{"type":"Metadata"}'), F.lit("no envelope"))).alias("value"))
    m = run_to_end(L.spoken(L.enveloped(lines)), "append")
    text = F.array_join(F.transform("words", lambda w: F.trim(w["text"])), "|")
    return m.select("transcript", "channel", "seq", "kind", F.size("words").alias("words"), F.element_at("words", -1)["end_ms"].alias("end_ms"), F.sha2(text, 256).alias("digest"))


@query(
    "changed_tables",
    "SELECT event_type AS table_name, max(event_id) AS seq, count(*) AS n FROM events GROUP BY 1",
    covers="s_cdc",
)
def changed_tables(spark, sf):
    """Commits coalesced by table: a stream of changes run to its end."""
    e = table_stream(spark, sf, "events").groupBy(F.col("event_type").alias("table_name")).agg(F.max("event_id").alias("seq"), F.count("*").alias("n"))
    return run_to_end(e, "complete")
