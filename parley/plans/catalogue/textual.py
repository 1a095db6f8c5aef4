"""Scalar text and time functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions import times
from parley.plans.catalog import query
from parley.sources.tables import load

_NOW = "1998-06-15"


@query(
    "clean_text",
    r"""SELECT conv_id, turn, length(c) AS n, sha256(c) AS digest FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      '# Title' || chr(10) || '- **x** [link](http://a) ![i](b) 1) ' || text, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`~#>]+', '', 'g'), '(?m)^\s*(?:[-+]|\d+[.)])\s+', '', 'g'), '\s+', ' ', 'g')) AS c FROM conversations)""",
    covers="sf_clean_md",
)
def clean_text(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", T.clean_markdown(F.concat(F.lit("# Title\n- **x** [link](http://a) ![i](b) 1) "), "text")).alias("c"))
    return c.select("conv_id", "turn", F.length("c").alias("n"), F.sha2("c", 256).alias("digest"))


@query(
    "strip_html",
    r"""SELECT page_id, length(c) AS n, sha256(c) AS digest FROM (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</p>', chr(10), 'g'), '<[^>]*>', ' ', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS c FROM pages)""",
    covers="x_strip_html",
)
def strip_html(spark, sf):
    p = load(spark, sf, "pages").select("page_id", T.strip_html("html").alias("c"))
    return p.select("page_id", F.length("c").alias("n"), F.sha2("c", 256).alias("digest"))


@query(
    "truncate_word",
    """SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN text ELSE (CASE WHEN instr(reverse(h), ' ') > 0 AND 60 - instr(reverse(h), ' ') > 36 THEN left(h, 60 - instr(reverse(h), ' ')) ELSE h END) || '...' END AS short
    FROM (SELECT conv_id, turn, text, left(text, 60) AS h FROM conversations)""",
    covers="sf_truncate_word",
)
def truncate_word(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", T.truncated("text", 60).alias("short"))


@query("title_keys", r"SELECT p_partkey, CASE WHEN k IN ('new note', 'untitled') THEN '' ELSE k END AS key FROM (SELECT p_partkey, trim(regexp_replace(lower(CASE WHEN p_size < 5 THEN ' New   Note ' ELSE p_name END), '\s+', ' ', 'g')) AS k FROM part)", covers="sf_title_key")
def title_keys(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.title_key(F.when(F.col("p_size") < 5, " New   Note ").otherwise(F.col("p_name"))).alias("key"))


@query(
    "page_text",
    "SELECT conv_id, string_agg(role || ' ' || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1",
    covers="x_page_text sink_md_export",
)
def page_text(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(" ", "role", "text").alias("t"))))
    return load(spark, sf, "conversations").groupBy("conv_id").agg(rows.alias("r")).select("conv_id", F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("body"))


@query(
    "line_diff",
    """WITH a AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations WHERE turn = 1),
    b AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN text ELSE 'new' || chr(10) || text END AS text FROM conversations WHERE turn = 1))
    SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, count(*) FILTER (WHERE a.line = b.line) AS same, count(*) FILTER (WHERE a.line <> b.line) AS changed, count(*) FILTER (WHERE a.line IS NULL) AS added, count(*) FILTER (WHERE b.line IS NULL) AS removed
    FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos GROUP BY 1""",
    covers="x_line_diff",
)
def line_diff(spark, sf):
    c = load(spark, sf, "conversations").where("turn = 1")
    a = c.select("conv_id", F.posexplode(F.split("text", "\n")).alias("pos", "a"))
    b = c.select("conv_id", F.posexplode(F.split(F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("new\n"), "text")), "\n")).alias("pos", "b"))
    j = a.join(b, ["conv_id", "pos"], "full_outer")
    return j.groupBy("conv_id").agg(F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"))


@query(
    "normalised_terms",
    r"""SELECT conv_id, turn, list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: list_position(list_transform(ws, lambda w: lower(w)), lower(x[1])) = x[2]), lambda x: x[1]) AS terms
    FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda w: trim(regexp_replace(w, '\s+', ' ', 'g'))), lambda w: length(w) >= 2) AS ws FROM conversations)""",
    covers="x_norm_list sf_norm_facts",
)
def normalised_terms(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", T.normalised_list(F.split("text", " ")).alias("terms"))


@query(
    "token_cores",
    r"""SELECT doc_id, sum(length(p))::BIGINT AS prefix, sum(length(c))::BIGINT AS core, sum(length(s))::BIGINT AS suffix FROM (
      SELECT doc_id, regexp_extract(w, '^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$', 1) AS p, regexp_extract(w, '^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$', 2) AS c, regexp_extract(w, '^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$', 3) AS s
      FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS w FROM documents)) GROUP BY 1""",
    covers="sf_core_affix",
)
def token_cores(spark, sf):
    w = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("w"))
    p, c, s = T.core_of("w")
    return w.groupBy("doc_id").agg(F.sum(F.length(p)).alias("prefix"), F.sum(F.length(c)).alias("core"), F.sum(F.length(s)).alias("suffix"))


@query("clock_values", "SELECT event_id, ((event_id // 3600) * 3600 + (event_id % 3600)) * 1000 AS ms, printf('%02d:%02d:%02d', event_id // 3600, event_id // 60 % 60, event_id % 60) AS code, 0::BIGINT AS bad FROM events", covers="sf_hhmmss sf_timecode sf_duration")
def clock_values(spark, sf):
    e = load(spark, sf, "events").select("event_id", times.timecode(F.col("event_id") * 1000).alias("code"))
    return e.select("event_id", times.clock_ms("code").alias("ms"), "code", times.clock_ms(F.lit("x:1")).alias("bad"))


@query("julian_days", "SELECT event_id, round(julian(ts) - 0.5, 4) AS day FROM events", covers="sf_julianday")
def julian_days(spark, sf):
    return load(spark, sf, "events").select("event_id", F.round(times.julian_day("ts"), 4).alias("day"))


@query(
    "time_buckets",
    f"""WITH d AS (SELECT date_diff('day', o_orderdate::DATE, DATE '{_NOW}') AS days, greatest(abs((1998 - year(o_orderdate)) * 12 + 6 - month(o_orderdate)), 1) AS months FROM orders),
    n AS (SELECT days, CASE WHEN abs(days) <= 6 THEN abs(days) WHEN abs(days) <= 27 THEN floor(abs(days) / 7 + 0.5)::BIGINT ELSE months END AS n, CASE WHEN abs(days) <= 6 THEN 'day' WHEN abs(days) <= 27 THEN 'week' ELSE 'month' END AS unit FROM d)
    SELECT CASE WHEN days = 0 THEN 'Today' WHEN days = 1 THEN 'Yesterday' WHEN days = -1 THEN 'Tomorrow' ELSE CASE WHEN days < 0 THEN 'in ' ELSE '' END || n || ' ' || unit || CASE WHEN n = 1 THEN '' ELSE 's' END || CASE WHEN days > 0 THEN ' ago' ELSE '' END END AS bucket,
      count(*) AS n FROM n GROUP BY 1""",
    covers="sf_bucket tl_buckets",
)
def time_buckets(spark, sf):
    label, _ = times.bucket(F.col("o_orderdate"), _NOW)
    return load(spark, sf, "orders").groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


_POLICY = "CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'forever' WHEN 2 THEN '30_days' WHEN 3 THEN '90_days' ELSE 'odd' END"


@query(
    "retention",
    f"""SELECT policy, count(*) FILTER (WHERE CASE policy WHEN 'none' THEN true WHEN '30_days' THEN TIMESTAMP '{_NOW}' >= o_orderdate + INTERVAL 30 DAY WHEN '90_days' THEN TIMESTAMP '{_NOW}' >= o_orderdate + INTERVAL 90 DAY ELSE false END) AS expired
    FROM (SELECT {_POLICY} AS policy, o_orderdate FROM orders) GROUP BY 1""",
    covers="f_expired",
)
def retention(spark, sf):
    o = load(spark, sf, "orders").select(F.expr(_POLICY).alias("policy"), "o_orderdate")
    return o.groupBy("policy").agg(F.count_if(times.expired(F.col("policy"), F.col("o_orderdate"), _NOW)).alias("expired"))


@query(
    "covered_timeline",
    """SELECT label, count(*) AS n FROM (SELECT 'session' AS label, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'event', event_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) GROUP BY 1""",
    covers="tl_buckets cal_link human_sessions",
)
def covered_timeline(spark, sf):
    s = load(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    e = load(spark, sf, "events").select(F.col("event_id").alias("id")).join(s, "id", "left_anti")
    return s.select(F.lit("session").alias("label")).unionByName(e.select(F.lit("event").alias("label"))).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "hashed_text",
    """SELECT p_partkey, printf('%08x', list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS fnv, sha256(p_name) AS sha FROM part""",
    covers="sf_fnv1a sf_sha256",
)
def hashed_text(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.fnv1a("p_name").alias("fnv"), F.sha2("p_name", 256).alias("sha"))


@query(
    "find_in_conversation",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS off FROM conversations),
    c AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS body FROM conversations GROUP BY 1),
    h AS (SELECT conv_id, body, instr(body, 'en') AS pos FROM c WHERE instr(body, 'en') > 0
      UNION ALL SELECT conv_id, body, pos + instr(substr(body, pos + 1), 'en') FROM h WHERE instr(substr(body, pos + 1), 'en') > 0)
    SELECT t.conv_id, t.turn, count(*) AS hits FROM h JOIN t ON t.conv_id = h.conv_id AND h.pos - 1 >= t.off AND h.pos - 1 <= t.off + length(t.text) GROUP BY 1, 2""",
    covers="x_find_in_text x_find_in_blocks",
)
def find_in_conversation(spark, sf):
    """Overlapping hits in the joined turns, each counted at the turn it starts in; a hit on the joint counts for the turn before it."""
    from parley.operators.search import overlapping_hits

    return overlapping_hits(load(spark, sf, "conversations"), "conv_id", "turn", "text", "en")
