"""Transcripts: words of conversations as timed words, to segments, labels, Markdown and subtitles."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import deltas as D
from parley.operators import transcript as P
from parley.plans.catalog import query
from parley.sources.tables import load
from parley.streaming import live_segments as L

#: A word of a turn starts 300 ms after the one before, a turn 15 minutes after the one before; the role is the channel.
_WORDS = r"""WITH w AS (SELECT conv_id AS transcript, turn, role, unnest(string_split_regex(trim(text), '\s+')) AS t, generate_subscripts(string_split_regex(trim(text), '\s+'), 1) - 1 AS pos FROM conversations),
words AS (SELECT transcript, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS channel, turn * 900000 + pos * 300 AS start_ms, turn * 900000 + pos * 300 + 250 AS end_ms, ' ' || t AS text FROM w)"""


def words(spark, sf):
    w = load(spark, sf, "conversations").select(F.col("conv_id").alias("transcript"), "turn", "role", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "t"))
    channel = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    start = F.col("turn") * 900_000 + F.col("pos") * 300
    return w.select(
        "transcript", F.concat_ws(":", "transcript", "turn", "pos").alias("id"), channel.alias("channel"), F.when(channel == 1, F.lit(None)).otherwise(F.lit(0)).cast("int").alias("speaker_index"),
        start.alias("start_ms"), (start + 250).alias("end_ms"), F.concat(F.lit(" "), "t").alias("text"),
    )


def _segments(spark, sf):
    return P.segments(words(spark, sf).withColumn("human", F.lit(None).cast("string")))


@query(
    "segments",
    _WORDS + """, f AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY transcript, channel ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3000 THEN 0 ELSE 1 END AS new FROM words),
    i AS (SELECT *, sum(new) OVER (PARTITION BY transcript, channel ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS island FROM f),
    b AS (SELECT *, (row_number() OVER (PARTITION BY transcript, channel, island ORDER BY start_ms) - 1) // 512 AS block FROM i)
    SELECT transcript, channel, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, sha256(trim(string_agg(text, '' ORDER BY start_ms))) AS digest FROM b GROUP BY transcript, channel, island, block""",
    covers="s_segments w_gapseg",
)
def segments(spark, sf):
    """Words are 300 ms apart here, so the cap of 512 words always comes before that of 300 s."""
    return _segments(spark, sf).select("transcript", "channel", "start_ms", "end_ms", "n", F.sha2("text", 256).alias("digest"))


_SAID = r"""WITH RECURSIVE t AS (SELECT conv_id AS transcript, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS channel, unnest(string_split_regex(trim(text), '\s+')) AS x, generate_subscripts(string_split_regex(trim(text), '\s+'), 1) - 1 AS pos FROM conversations),
    k AS (SELECT *, pos // 40 AS part, turn * 900000 + pos * 300 + (pos // 40) * 5000 AS start_ms, CASE WHEN channel = 1 THEN 0 WHEN transcript % 3 <> 0 THEN (pos // 80) % 2 END AS speaker FROM t),
    w AS (SELECT *, CASE WHEN channel = 0 AND speaker = 0 AND transcript % 5 = 0 THEN 'me' WHEN channel = 1 AND transcript % 2 = 0 THEN 'h1' END AS human FROM k),
    b AS MATERIALIZED (
      SELECT transcript, channel, any_value(speaker) AS speaker, any_value(human) AS human, min(start_ms) AS start_ms, max(start_ms) + 250 AS end_ms, count(*) AS n, string_agg(x, ' ' ORDER BY pos) AS text,
        row_number() OVER (PARTITION BY transcript ORDER BY min(start_ms), max(start_ms), channel, string_agg(x, ' ' ORDER BY pos)) AS i
      FROM w GROUP BY transcript, channel, turn, part),
    r AS (
      SELECT transcript, i, 1::BIGINT AS block, channel, speaker, human, n, start_ms, end_ms FROM b WHERE i = 1
      UNION ALL
      SELECT b.transcript, b.i, r.block + (NOT joins)::BIGINT, b.channel, CASE WHEN joins THEN r.speaker ELSE b.speaker END, CASE WHEN joins THEN r.human ELSE b.human END, CASE WHEN joins THEN r.n + b.n ELSE b.n END, CASE WHEN joins THEN r.start_ms ELSE b.start_ms END, b.end_ms
      FROM r JOIN b ON b.transcript = r.transcript AND b.i = r.i + 1,
        LATERAL (SELECT b.channel = r.channel AND (coalesce(b.human = r.human, FALSE) OR (b.speaker IS NOT DISTINCT FROM r.speaker AND b.human IS NOT DISTINCT FROM r.human AND (b.speaker IS NOT NULL OR b.human IS NOT NULL)))
          AND r.end_ms - 250 <= b.start_ms AND b.start_ms - r.end_ms <= 40000 AND r.n + b.n <= 512 AND b.end_ms - r.start_ms <= 300000 AS joins)),
    m AS MATERIALIZED (
      SELECT r.transcript, r.block, any_value(r.channel) AS channel, any_value(r.speaker) AS speaker, any_value(r.human) AS human, min(r.start_ms) AS start_ms, max(r.end_ms) AS end_ms, string_agg(b.text, ' ' ORDER BY r.i) AS text
      FROM r JOIN b ON b.transcript = r.transcript AND b.i = r.i GROUP BY r.transcript, r.block),
    u AS (SELECT transcript, channel, speaker, row_number() OVER (PARTITION BY transcript ORDER BY min(start_ms), channel, speaker NULLS FIRST) AS number FROM m WHERE human IS NULL GROUP BY transcript, channel, speaker),
    l AS (
      SELECT m.*, CASE human WHEN 'h1' THEN 'Ada' WHEN 'me' THEN 'You' ELSE 'Speaker ' || number END AS label
      FROM m LEFT JOIN u ON m.human IS NULL AND u.transcript = m.transcript AND u.channel = m.channel AND u.speaker IS NOT DISTINCT FROM m.speaker)"""


def said(spark, sf):
    """Words that pause five seconds after every 40; the user's are of one or two speakers, or of none that is known."""
    w = words(spark, sf)
    pos = F.floor(F.col("start_ms") % 900_000 / 300)
    pause = (F.floor(pos / 40) * 5000).cast("long")
    speaker = F.when(F.col("channel") == 1, 0).when(F.col("transcript") % 3 != 0, F.floor(pos / 80) % 2).cast("int")
    return w.select("transcript", "id", "channel", speaker.alias("speaker_index"), (F.col("start_ms") + pause).alias("start_ms"), (F.col("end_ms") + pause).alias("end_ms"), "text")


@query(
    "segments_render",
    _SAID + """ SELECT transcript, sha256(string_agg('**[' || printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || '] ' || label || '**' || chr(10) || text, chr(10) || chr(10) ORDER BY start_ms, end_ms, channel)) AS digest, count(*) AS blocks FROM l GROUP BY 1""",
    covers="s_display_merge s_render s_label s_identity x_md_transcript",
)
def segments_render(spark, sf):
    """Transcripts as Markdown: who spoke by hints of channels and speakers, neighbours of one speaker joined up to 512 words and five minutes."""
    w = said(spark, sf)
    own = w.select("transcript").distinct()
    hint = lambda rows, scope, channel, speaker, human: rows.select("transcript", F.lit(scope).alias("scope"), F.lit(None).cast("string").alias("word_id"), F.lit(channel).alias("channel"), F.lit(speaker).cast("int").alias("speaker_index"), F.lit(human).alias("human"))
    hints = hint(own.where("transcript % 2 = 0"), "channel", 1, None, "h1").union(hint(own.where("transcript % 5 = 0"), "speaker", 0, 0, "me"))
    blocks = P.merged(P.segments(P.identities(w, hints)))
    names = spark.createDataFrame([("h1", "Ada")], "human string, name string")
    return P.markdown(P.labelled(blocks, F.broadcast(names), "me")).select("transcript", F.sha2("body", 256).alias("digest"), "blocks")


@query(
    "subtitles",
    _WORDS + """ SELECT transcript, sha256('WEBVTT' || chr(10) || chr(10) || string_agg(printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' ||
      printf('%02d:%02d:%02d.%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY start_ms, end_ms, text)) AS digest FROM words GROUP BY 1""",
    covers="sink_vtt src_subtitle",
)
def subtitles(spark, sf):
    return P.subtitles(words(spark, sf)).select("transcript", F.sha2("body", 256).alias("digest"))


def deltas(spark, sf):
    """Deltas of live transcripts from turns, 15 minutes apart: a turn's words, with a partial of its last ones; in every third turn a correction that puts one word for the first two; every fourth transcript sends its deltas twice."""
    c = load(spark, sf, "conversations").select(F.col("conv_id").alias("transcript"), "turn", (F.col("role") == "assistant").cast("int").alias("channel"), F.filter(F.split("text", "[ \\n]+"), lambda x: x != "").alias("t"))
    word = lambda name, text, i, k: F.struct(F.concat_ws(":", "turn", name).alias("id"), text.alias("text"), (F.col("turn") * 900_000 + i * 300).cast("long").alias("start_ms"), (F.col("turn") * 900_000 + (i + k) * 300 - 50).cast("long").alias("end_ms"), "channel", F.col("channel").alias("speaker_index"), F.lit(None).cast("string").alias("human"))
    words = F.transform("t", lambda x, i: word(i.cast("string"), F.concat(F.lit(" "), x), i, 1))
    partials = F.transform(F.slice(words, -2, 2), lambda w: F.struct(F.concat(w["text"], F.lit("...")).alias("text"), (w["end_ms"] + 50).alias("start_ms"), (w["end_ms"] + 300).alias("end_ms"), w["channel"].alias("channel")))
    first = c.where(F.size("t") > 1).select("transcript", (F.col("turn") * 2).alias("seq"), words.alias("new_words"), F.array().cast("array<string>").alias("replaced_ids"), partials.alias("partials"))
    fix = word(F.lit("fix"), F.lit(" fixed"), F.lit(0), F.lit(2))
    second = c.where((F.size("t") > 1) & (F.col("turn") % 3 == 1)).select("transcript", (F.col("turn") * 2 + 1).alias("seq"), F.array(fix).alias("new_words"), F.array(F.concat_ws(":", "turn", F.lit("0")), F.concat_ws(":", "turn", F.lit("1"))).alias("replaced_ids"), F.array().cast(f"array<{L.PARTIAL}>").alias("partials"))
    once = first.union(second)
    return once.union(once.where("transcript % 4 = 0"))


_DELTA_WORDS = r"""t AS (SELECT conv_id AS transcript, turn, (role = 'assistant')::INT AS channel, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') AS t FROM conversations),
    w AS (SELECT transcript, turn, channel, unnest(t) AS x, generate_subscripts(t, 1) - 1 AS i, len(t) AS n FROM t WHERE len(t) > 1),
    p AS (SELECT transcript, turn, channel, turn || ':' || i AS id, ' ' || x AS text, turn * 900000 + i * 300 AS start_ms, turn * 900000 + i * 300 + 250 AS end_ms FROM w WHERE NOT (turn % 3 = 1 AND i < 2)
      UNION ALL SELECT DISTINCT transcript, turn, channel, turn || ':fix', ' fixed', turn * 900000, turn * 900000 + 550 FROM w WHERE turn % 3 = 1)"""


@query(
    "live_segments",
    f"""WITH {_DELTA_WORDS},
    l AS (SELECT transcript, max(turn) AS turn FROM w GROUP BY 1),
    q AS (SELECT w.transcript, w.channel, w.turn, w.turn * 900000 + i * 300 + 300 AS start_ms, w.turn * 900000 + i * 300 + 550 AS end_ms, ' ' || x || '...' AS text, n FROM w JOIN l USING (transcript, turn) WHERE i >= n - 2),
    e AS (SELECT transcript, max(end_ms) AS latest FROM (SELECT transcript, end_ms FROM p UNION ALL SELECT transcript, end_ms FROM q) GROUP BY 1),
    k AS (SELECT p.*, row_number() OVER (PARTITION BY transcript ORDER BY start_ms DESC, id DESC) AS r, sum(octet_length(encode(text))) OVER (PARTITION BY transcript ORDER BY start_ms DESC, id DESC ROWS UNBOUNDED PRECEDING) AS size FROM p JOIN e USING (transcript) WHERE end_ms >= latest - 1800000),
    a AS (SELECT transcript, channel, start_ms, end_ms, 0 AS partial, text FROM k WHERE r <= 4096 AND (size <= 65536 OR r = 1) UNION ALL SELECT transcript, channel, start_ms, end_ms, 1, text FROM q WHERE turn % 3 <> 1),
    f AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY transcript, channel ORDER BY start_ms, end_ms, partial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3000 THEN 0 ELSE 1 END AS new FROM a),
    s AS (SELECT *, sum(new) OVER (PARTITION BY transcript, channel ORDER BY start_ms, end_ms, partial ROWS UNBOUNDED PRECEDING) AS island FROM f),
    b AS (SELECT *, (row_number() OVER (PARTITION BY transcript, channel, island ORDER BY start_ms, end_ms, partial) - 1) // 512 AS block FROM s)
    SELECT transcript, channel, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*)::INT AS n, sha256(trim(string_agg(text, '' ORDER BY start_ms, end_ms, partial))) AS digest FROM b GROUP BY transcript, channel, island, block""",
    covers="s_live_segments sf_stable_id",
)
def live_segments(spark, sf):
    """What stands after all changes of live segments; the window of half an hour leaves the last turns. Tests hold the stream to these changes."""
    now = L.current(L.batch_changes(deltas(spark, sf)))
    return now.select("transcript", "channel", "start_ms", "end_ms", "n", F.sha2("text", 256).alias("digest"))


@query(
    "delta_fold",
    f"""WITH {_DELTA_WORDS},
    hints AS (SELECT transcript, count(*) AS hints FROM (SELECT transcript FROM w WHERE i < 4 AND NOT (turn % 3 = 1 AND i = 1) UNION ALL SELECT transcript FROM p) GROUP BY 1)
    SELECT transcript, words, chars, first_ms, hints FROM (SELECT transcript, count(*) AS words, sum(length(text))::BIGINT AS chars, min(start_ms) AS first_ms FROM p GROUP BY 1) JOIN hints USING (transcript)""",
    covers="s_delta_apply x_live_delta_fold",
)
def delta_fold(spark, sf):
    """Words, and hints on them, after a log with replaced words and replays: hints on the first four words of a turn, of which that of a speaker lasts where its word goes."""
    d = deltas(spark, sf)
    mine = d.where("seq % 2 = 0").select("transcript", "seq", F.posexplode(F.slice("new_words", 1, 4)).alias("i", "w")).distinct()
    scope = F.when(F.col("i") == 0, "speaker").when(F.col("i") == 2, "segment").otherwise("word")
    hints = D.folded_hints(d, mine.select("transcript", "seq", F.col("w.id").alias("word_id"), F.lit("mine").alias("kind"), scope.alias("scope"), F.lit("x").alias("value")))
    words = D.folded_words(d).groupBy("transcript").agg(F.count("*").alias("words"), F.sum(F.length("text")).alias("chars"), F.min("start_ms").alias("first_ms"))
    return words.join(hints.groupBy("transcript").agg(F.count("*").alias("hints")), "transcript")
