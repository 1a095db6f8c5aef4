"""Search documents of sessions, creation and promotion, chunks, second passes over segments, and small text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import document_tree as D
from parley.functions import text as T
from parley.functions.json_tree import json_each, json_tree
from parley.operators import sessions as S
from parley.operators import transcript as P
from parley.plans.catalog import query
from parley.sources.tables import load


@query("iso_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp FROM events", covers="sf_strftime")
def iso_stamps(spark, sf):
    return load(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("stamp"))


@query(
    "spaced_words",
    r"""WITH w AS (SELECT conv_id, turn, text, turn % 3 = 0 AS lead, unnest(string_split_regex(trim(text), '\s+')) AS t, generate_subscripts(string_split_regex(trim(text), '\s+'), 1) AS pos FROM conversations WHERE trim(text) <> ''),
    x AS (SELECT conv_id, turn, pos, CASE WHEN pos % 5 = 0 THEN '.' ELSE '' END || CASE WHEN lead THEN '  ' ELSE '' END || t AS word FROM w),
    y AS (SELECT *, regexp_replace(word, '^\s+', '') AS bare FROM x)
    SELECT conv_id, turn, pos::BIGINT AS pos, CASE WHEN bare = '' THEN word WHEN pos = 1 THEN bare WHEN word[1] = ' ' THEN word WHEN contains(',.;:!?)}]''', bare[1]) THEN bare ELSE ' ' || bare END AS word FROM y""",
    covers="sf_word_space",
)
def spaced_words(spark, sf):
    """Words of turns, some with leading spaces and some that begin with a mark."""
    c = load(spark, sf, "conversations").where(F.trim("text") != "").select("conv_id", "turn", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "t"))
    word = F.concat(F.when((F.col("pos") + 1) % 5 == 0, ".").otherwise(""), F.when(F.col("turn") % 3 == 0, "  ").otherwise(""), "t")
    return c.select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("pos"), T.spaced_word(word, F.col("pos") == 0).alias("word"))


@query(
    "search_projection",
    r"""WITH c AS (SELECT conv_id, turn, role, regexp_replace(trim(text), '\s+', ' ', 'g') AS t FROM conversations),
    p AS (SELECT conv_id,
      (list(t ORDER BY turn) FILTER (WHERE role = 'user'))[1] AS note,
      string_agg(NULLIF(t, ''), ' ' ORDER BY turn) FILTER (WHERE role = 'assistant' AND turn % 2 = 1) AS summaries,
      string_agg(trim('teams ' || role || CASE WHEN t = '' THEN '' ELSE ' ' || t END || ' http://x/' || turn), ' ' ORDER BY turn) FILTER (WHERE turn % 3 = 0) AS chat,
      string_agg(NULLIF(t, ''), ' ' ORDER BY turn) AS spoken FROM c GROUP BY 1)
    SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id % 11 = 0 THEN 'remove' ELSE 'upsert' END AS action,
      CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 4 = 0 THEN 'Untitled' ELSE 'Talk ' || conv_id END AS title,
      CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 7 = 0 THEN '' ELSE list_aggregate(list_filter([note, summaries, chat, spoken, 'zoom Z'], lambda x: x IS NOT NULL AND x <> ''), 'string_agg', ' ') END AS content,
      CASE WHEN conv_id % 11 = 0 THEN NULL ELSE conv_id * 1000 END AS created_at FROM p""",
    covers="fts_project sf_flatten_transcript sf_flatten_chat sf_flatten_apps sf_merge_content sf_plaintext",
)
def search_projection(spark, sf):
    """Conversations as sessions: the first user turn as note, assistant turns as summaries, chat as JSON, and all turns as a transcript's JSON."""
    c = load(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.trim(F.regexp_replace(F.trim("text"), r"\s+", " ")).alias("t"))
    id_ = F.col("conv_id").cast("string")
    doc = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("t").alias("text"))).alias("content")))
    chat = F.to_json(F.struct(F.lit("teams").alias("platform"), F.col("role").alias("sender"), F.col("t").alias("text"), F.array(F.concat(F.lit("http://x/"), F.col("turn").cast("string"))).alias("links")))
    rows = lambda kind, body, where: c.where(where).select(id_.alias("session"), F.format_string("%09d", "turn").alias("id"), F.lit(kind).alias("kind"), body.alias("body"), F.col("turn").alias("sort_order"), F.lit("").alias("created_at"))
    documents = rows("note", doc, "role = 'user'").unionByName(rows("summary", doc, "role = 'assistant' and turn % 2 = 1")).unionByName(rows("meeting_chat", chat, "turn % 3 = 0"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: F.struct(x["t"].alias("text")))
    transcripts = c.groupBy("conv_id").agg(F.to_json(words).alias("words")).select(id_.alias("session"), id_.alias("id"), "words", F.lit(0).alias("started_at_ms"))
    k = F.col("conv_id")
    sessions = c.select("conv_id").distinct().select(
        id_.alias("id"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("Talk "), id_)).alias("title"), (k % 7 == 0).alias("locked"), (k % 11 == 0).alias("deleted"), (k * 1000).alias("created_at"), F.lit('[{"app":"zoom","name":"Z"},3]').alias("apps")
    )
    return S.search_documents(sessions, documents, transcripts)


@query(
    "created_sessions",
    """SELECT e.event_id, e.external FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'x' || user_id END AS external FROM events) e
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = e.event_id AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0 AND e.external <> '' AND e.external = 'x' || o_custkey)""",
    covers="x_create_once",
)
def created_sessions(spark, sf):
    """Events without a session under either key; orders stand for the sessions that exist."""
    external = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("x"), F.col("user_id").cast("string")))
    e = load(spark, sf, "events").select(F.col("event_id").alias("event"), external.alias("external"))
    had = load(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).otherwise("").alias("external"))
    return S.created_once(e, had).select(F.col("event").alias("event_id"), "external")


@query(
    "created_participants",
    """WITH i AS (SELECT o_orderkey AS event, l_linenumber AS pos, upper('Supplier' || l_suppkey || '@x.org ') AS email, 'n' || l_linenumber AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    f AS (SELECT event, lower(trim(email)) AS email, min_by(name, pos) AS name FROM i GROUP BY 1, 2),
    h AS (SELECT lower(s_name) AS human, 'supplier' || s_suppkey || '@x.org' AS email FROM supplier WHERE s_suppkey % 2 = 0)
    SELECT event, f.email, coalesce(human, sha256(f.email)) AS human, name, human IS NULL AS is_new FROM f LEFT JOIN h ON h.email = f.email""",
    covers="x_create_once",
)
def created_participants(spark, sf):
    """Participants of new sessions: each address once, known humans by address, others new."""
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("pos"), F.upper(F.concat(F.lit("Supplier"), F.col("l_suppkey").cast("string"), F.lit("@x.org "))).alias("email"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name"))
    humans = load(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.lower("s_name").alias("human"), F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string"), F.lit("@x.org")).alias("email"))
    return S.participants_once(li, humans)


@query(
    "promoted_candidates",
    """WITH w AS (SELECT l_suppkey AS id, max_by(l_partkey, (l_discount * 10, l_partkey)) AS human, max(l_discount * 10) AS confidence FROM lineitem WHERE l_discount * 10 <= 1 AND l_partkey % 2 = 0 GROUP BY 1)
    SELECT s_suppkey AS id, w.human, s_acctbal < 0 AS was_deleted, s_acctbal >= 0 AND w.id IS NOT NULL AS is_exemplar, CASE WHEN s_acctbal < 0 THEN 'old' WHEN w.id IS NOT NULL THEN 'now' END AS deleted_at FROM supplier LEFT JOIN w ON w.id = s_suppkey AND s_acctbal >= 0""",
    covers="x_promote m_tomb_returning",
)
def promoted_candidates(spark, sf):
    """Suppliers as candidates; both tables that a promotion changes, side by side."""
    c = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") < 0).alias("was_deleted"), F.when(F.col("s_acctbal") < 0, "old").alias("deleted_at"))
    wanted = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("human"), (F.col("l_discount") * 10).alias("confidence"))
    humans = load(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("human"))
    exemplars, after = S.promoted(c, wanted, humans, F.lit("now"))
    return after.join(exemplars.select("id", "human", F.lit(True).alias("e")), "id", "left").select("id", "human", "was_deleted", F.coalesce("e", F.lit(False)).alias("is_exemplar"), "deleted_at")


def _chunks(spark, sf):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(400_000))
    e = load(spark, sf, "events").select(F.col("user_id").alias("recording"), at.alias("start_ms"), F.pmod(F.col("event_id") * 37, F.lit(400)).alias("speech_ms"))
    return e.groupBy("recording", "start_ms").agg(F.max("speech_ms").alias("speech_ms")).select("recording", "start_ms", (F.col("start_ms") + F.col("speech_ms") + 50).alias("end_ms"), "speech_ms")


@query(
    "speech_chunks",
    """WITH RECURSIVE e AS (SELECT user_id AS recording, epoch_us(ts) // 400000 AS start_ms, max(event_id * 37 % 400) AS speech_ms FROM events GROUP BY 1, 2),
    c AS MATERIALIZED (SELECT recording, start_ms, start_ms + speech_ms + 50 AS end_ms, speech_ms, row_number() OVER (PARTITION BY recording ORDER BY start_ms) AS i FROM e),
    f(recording, i, o_start, o_end, o_speech, o_n, p_start, p_end, p_speech, p_n) AS (
      SELECT recording, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT recording FROM c)
      UNION ALL
      SELECT f.recording, c.i,
        CASE WHEN p_n IS NULL THEN CASE WHEN speech_ms >= 200 THEN start_ms END WHEN near THEN CASE WHEN p_speech + speech_ms >= 200 THEN p_start END ELSE p_start END,
        CASE WHEN p_n IS NULL THEN CASE WHEN speech_ms >= 200 THEN end_ms END WHEN near THEN CASE WHEN p_speech + speech_ms >= 200 THEN end_ms END ELSE p_end END,
        CASE WHEN p_n IS NULL THEN CASE WHEN speech_ms >= 200 THEN speech_ms END WHEN near THEN CASE WHEN p_speech + speech_ms >= 200 THEN p_speech + speech_ms END ELSE p_speech END,
        CASE WHEN p_n IS NULL THEN CASE WHEN speech_ms >= 200 THEN 1 END WHEN near THEN CASE WHEN p_speech + speech_ms >= 200 THEN p_n + 1 END ELSE p_n END,
        CASE WHEN p_n IS NULL THEN CASE WHEN speech_ms < 200 THEN start_ms END WHEN near THEN CASE WHEN p_speech + speech_ms < 200 THEN p_start END ELSE start_ms END,
        CASE WHEN p_n IS NULL THEN CASE WHEN speech_ms < 200 THEN end_ms END WHEN near THEN CASE WHEN p_speech + speech_ms < 200 THEN end_ms END ELSE end_ms END,
        CASE WHEN p_n IS NULL THEN CASE WHEN speech_ms < 200 THEN speech_ms END WHEN near THEN CASE WHEN p_speech + speech_ms < 200 THEN p_speech + speech_ms END ELSE speech_ms END,
        CASE WHEN p_n IS NULL THEN CASE WHEN speech_ms < 200 THEN 1 END WHEN near THEN CASE WHEN p_speech + speech_ms < 200 THEN p_n + 1 END ELSE 1 END
      FROM f JOIN (SELECT *, FALSE AS unused FROM c) c ON c.recording = f.recording AND c.i = f.i + 1, LATERAL (SELECT greatest(c.start_ms - f.p_end, 0) <= 250 AS near))
    SELECT recording, o_start AS start_ms, o_end AS end_ms, o_speech AS speech_ms, o_n AS n FROM f WHERE o_n IS NOT NULL
    UNION ALL SELECT recording, p_start, p_end, p_speech, p_n FROM f WHERE p_n IS NOT NULL AND i = (SELECT max(i) FROM c WHERE c.recording = f.recording)""",
    covers="s_chunk_merge",
)
def speech_chunks(spark, sf):
    return S.merged_chunks(_chunks(spark, sf), 600)


@query(
    "propagated_segments",
    r"""WITH RECURSIVE t AS (SELECT conv_id AS transcript, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS channel, unnest(string_split_regex(trim(text), '\s+')) AS x, generate_subscripts(string_split_regex(trim(text), '\s+'), 1) - 1 AS pos FROM conversations),
    b AS MATERIALIZED (
      SELECT transcript, channel, turn * 900000 + min(pos) * 300 AS start_ms, turn * 900000 + max(pos) * 300 + 250 AS end_ms, count(*) AS n, (pos // 40) % 3 AS speaker,
        CASE WHEN transcript % 3 = 0 OR (transcript % 3 = 1 AND (pos // 40) % 3 < 2) THEN 'h' END AS human, row_number() OVER (PARTITION BY transcript, channel ORDER BY turn, pos // 40) AS i
      FROM t GROUP BY transcript, channel, turn, pos // 40),
    r AS (
      SELECT transcript, channel, i, 1::BIGINT AS block, n, start_ms, end_ms, speaker, human FROM b WHERE i = 1
      UNION ALL
      SELECT b.transcript, b.channel, b.i, r.block + (NOT joins)::BIGINT, CASE WHEN joins THEN r.n + b.n ELSE b.n END, CASE WHEN joins THEN r.start_ms ELSE b.start_ms END, b.end_ms, CASE WHEN joins THEN r.speaker ELSE b.speaker END, CASE WHEN joins THEN r.human ELSE b.human END
      FROM r JOIN b ON b.transcript = r.transcript AND b.channel = r.channel AND b.i = r.i + 1,
        LATERAL (SELECT coalesce(b.human = r.human, b.human IS NULL AND r.human IS NULL AND b.speaker = r.speaker) AND b.start_ms - r.end_ms <= 3000 AND r.n + b.n <= 512 AND b.end_ms - r.start_ms <= 300000 AS joins))
    SELECT transcript, channel, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(n)::BIGINT AS n, any_value(speaker)::INT AS speaker_index, any_value(human) AS human FROM r GROUP BY transcript, channel, block""",
    covers="s_propagate",
)
def propagated_segments(spark, sf):
    """Segments of words whose speaker changes every 40 words, joined again where two or three of the speakers are one human; long turns reach the cap of 512 words."""
    from parley.plans.catalogue.transcripts import words

    w = words(spark, sf).withColumn("speaker_index", (F.floor(F.col("start_ms") % 900_000 / 12_000) % 3).cast("int"))
    human = F.when((F.col("transcript") % 3 == 0) | ((F.col("transcript") % 3 == 1) & (F.col("speaker_index") < 2)), "h")
    return P.propagated(P.segments(w.withColumn("human", human))).select("transcript", "channel", "start_ms", "end_ms", "n", "speaker_index", "human")


@query(
    "neutral_labels",
    r"""WITH t AS (SELECT conv_id AS transcript, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS c, generate_subscripts(string_split_regex(trim(text), '\s+'), 1) - 1 AS pos FROM conversations),
    w AS (SELECT transcript, transcript || ':' || (turn * 900000 + pos * 300) || ':' || c AS id, CASE WHEN transcript % 2 = 0 THEN 0 ELSE c END AS channel, CASE WHEN transcript % 2 = 1 AND c <> 1 THEN 0 END AS speaker_index, pos % 10 = 0 AS by_hand FROM t),
    m AS (SELECT transcript FROM w GROUP BY 1 HAVING count(DISTINCT channel) <= 1 AND count(DISTINCT CASE WHEN speaker_index IS NOT NULL THEN channel || '/' || speaker_index END) <= 1 AND transcript % 3 <> 0)
    SELECT w.transcript, id, channel, speaker_index, m.transcript IS NOT NULL AND NOT by_hand AS neutral FROM w LEFT JOIN m USING (transcript)""",
    covers="s_neutralize",
)
def neutral_labels(spark, sf):
    """Words of conversations whose labels say nothing; every tenth word of a turn is assigned by hand."""
    from parley.plans.catalogue.transcripts import words

    w = words(spark, sf)
    one = w.select("transcript", F.concat_ws(":", "transcript", "start_ms", "channel").alias("id"), F.when(F.col("transcript") % 2 == 0, 0).otherwise(F.col("channel")).alias("channel"), F.when(F.col("transcript") % 2 == 1, F.col("speaker_index")).alias("speaker_index"))
    hints = one.select("transcript", F.lit("word").alias("scope"), F.col("id").alias("word_id"), "channel", "speaker_index", F.lit("h").alias("human"), F.lit(True).alias("by_hand")).where("cast(split_part(word_id, ':', 2) as long) % 900000 % 3000 = 0")
    took_part = one.select("transcript", F.when(F.col("transcript") % 3 == 0, "me").otherwise("other").alias("human")).distinct()
    return P.neutral_words(one, hints, took_part, "me")


_NESTED = """WITH c AS (SELECT conv_id, to_json({'id': conv_id, 'mine': conv_id % 2 = 0, 'turns': list({'role': role, 'n': turn, 'share': turn / 4, 'none': NULL, 'first words': string_split(text, ' ')[1:3]} ORDER BY turn)})::VARCHAR AS body FROM conversations GROUP BY 1)"""


def nested(spark, sf):
    """A JSON document of each conversation: its turns, with their first words as a list."""
    turn = F.struct("turn", F.to_json(F.struct("role", F.col("turn").alias("n"), (F.col("turn") / 4).alias("share"), F.lit(None).cast("string").alias("none"), F.slice(F.split("text", " "), 1, 3).alias("first words")), {"ignoreNullFields": "false"}).alias("j"))
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["j"]), ",").alias("turns"))
    mine = F.when(F.col("conv_id") % 2 == 0, "true").otherwise("false")
    return c.select("conv_id", F.concat(F.lit('{"id":'), F.col("conv_id").cast("string"), F.lit(',"mine":'), mine, F.lit(',"turns":['), "turns", F.lit("]}")).alias("body"))


_TYPES = "CASE WHEN j.type IN ('BIGINT', 'UBIGINT') THEN 'integer' WHEN j.type = 'DOUBLE' THEN 'real' WHEN j.type = 'VARCHAR' THEN 'text' WHEN j.type = 'BOOLEAN' THEN j.atom::VARCHAR ELSE lower(j.type) END"


@query(
    "json_values",
    f"""{_NESTED} SELECT conv_id, j.key, j.fullkey AS full_key, {_TYPES} AS type, CASE WHEN j.type = 'VARCHAR' THEN j.atom ->> '$' WHEN j.type NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN j.atom::VARCHAR END AS atom
    FROM c, json_tree(c.body) j""",
    covers="sf_json_tree sf_json_type",
)
def json_values(spark, sf):
    """Every value of nested JSON, at any depth, with its path and type."""
    return json_tree(nested(spark, sf), "body").select("conv_id", "key", "full_key", "type", "atom")


@query(
    "json_join",
    f"""{_NESTED}, t AS (SELECT conv_id, json_extract(body, '$.turns')::VARCHAR AS turns FROM c),
    e AS (SELECT conv_id, j.key::BIGINT AS place, j.value AS v FROM t, json_each(t.turns) j)
    SELECT e.conv_id, place, v ->> '$.role' AS role, json_array_length(v, '$."first words"')::INT AS words, length(c.text) AS chars FROM e JOIN conversations c ON c.conv_id = e.conv_id AND c.turn = (v ->> '$.n')::BIGINT""",
    covers="j_json_table sf_json_each sf_json_array_length sf_json_extract",
)
def json_join(spark, sf):
    """The elements of a JSON array as a table, joined to the turns that they name."""
    turns = nested(spark, sf).select("conv_id", F.to_json(F.variant_get(F.parse_json("body"), "$.turns", "variant")).alias("turns"))
    field = lambda name, kind: F.get_json_object("v", f"$.{name}").cast(kind)
    rows = json_each(turns, "turns").select("conv_id", F.col("key").cast("long").alias("place"), F.col("value").alias("v"))
    words = F.size(F.from_json(F.get_json_object("v", "$['first words']"), "array<string>"))
    e = rows.select("conv_id", "place", field("role", "string").alias("role"), field("n", "long").alias("turn"), words.alias("words"))
    return e.join(load(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("chars")), ["conv_id", "turn"]).drop("turn")


@query(
    "note_trees",
    """WITH c AS (SELECT conv_id, turn, role, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations),
    k AS (SELECT conv_id, turn, role, w, len(w) AS n FROM c WHERE len(w) >= 6)
    SELECT conv_id, sha256(string_agg('## ' || role || chr(10) || chr(10) || w[1] || ' **' || w[2] || '** *' || w[3] || '*' || chr(10) || chr(10) || '- ' || w[4] || chr(10) || '- [' || w[5] || '](http://x/' || turn || ')' || chr(10) || chr(10) || '> ' || w[6], chr(10) || chr(10) ORDER BY turn)) AS digest,
      count(*) AS headings, 4 * count(*) AS paragraphs, 2 * count(*) AS items, count(*) AS bold, count(*) AS links, sum(length(role) + length(array_to_string(w[1:6], '')) + 2)::BIGINT AS chars FROM k GROUP BY 1""",
    covers="sf_md_tiptap",
)
def note_trees(spark, sf):
    """Notes of conversations in Markdown, to document trees and back to the same text; nodes and marks counted in the trees."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0).alias("w")).where(F.size("w") >= 6)
    w = [F.get("w", F.lit(i)) for i in range(6)]
    turn = F.col("turn").cast("string")
    body = F.concat(F.lit("## "), "role", F.lit("\n\n"), w[0], F.lit(" **"), w[1], F.lit("** *"), w[2], F.lit("*\n\n* "), w[3], F.lit("\n* ["), w[4], F.lit("](http://x/"), turn, F.lit(")\n\n>"), w[5], F.lit("\n"))
    notes = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("t")))), lambda x: x["t"]), "\n").alias("note"))
    trees = notes.select("conv_id", D.tree_of("note").alias("tree"))
    v = json_tree(trees, "tree").where("key in ('type', 'text')")
    count = lambda kind: F.count_if((F.col("key") == "type") & (F.col("atom") == kind))
    parts = v.groupBy("conv_id").agg(count("heading").alias("headings"), count("paragraph").alias("paragraphs"), count("listItem").alias("items"), count("bold").alias("bold"), count("link").alias("links"), F.sum(F.when(F.col("key") == "text", F.length("atom")).otherwise(0)).alias("chars"))
    return trees.select("conv_id", F.sha2(D.markdown_of("tree"), 256).alias("digest")).join(parts, "conv_id")
