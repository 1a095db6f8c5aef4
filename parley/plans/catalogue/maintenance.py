"""Result tables after upserts, tombstones, ingests and consolidations."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import jsonx
from parley.operators import merge as M
from parley.plans.catalog import query
from parley.sources.tables import load


def _target(spark, sf):
    return load(spark, sf, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _source(spark, sf):
    return load(spark, sf, "orders").where("o_orderkey >= 9000").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))


_T = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0"
_S = "SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey >= 9000"


@query("upsert", f"SELECT * FROM ({_T}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_S})) UNION ALL {_S}", covers="m_upsert")
def upsert(spark, sf):
    return M.upsert(_target(spark, sf), _source(spark, sf), ["o_orderkey"])


@query("insert_missing", f"{_T} UNION ALL SELECT * FROM ({_S}) WHERE o_orderkey % 2 <> 0", covers="m_insert_missing")
def insert_missing(spark, sf):
    return M.insert_missing(_target(spark, sf), _source(spark, sf), ["o_orderkey"])


@query("upsert_counter", "SELECT user_id, sum(g)::BIGINT AS generation FROM (SELECT DISTINCT user_id, 5 AS g FROM events WHERE user_id < 50 UNION ALL SELECT user_id, 1 FROM events WHERE event_type = 'click') GROUP BY 1", covers="m_upsert_counter")
def upsert_counter(spark, sf):
    e = load(spark, sf, "events")
    state = e.where("user_id < 50").select("user_id", F.lit(5).cast("long").alias("generation")).distinct()
    return M.upsert_counter(state, e.where("event_type = 'click'"), ["user_id"])


@query("upsert_where", f"SELECT * FROM ({_T}) WHERE o_orderkey < 9000 OR o_orderstatus <> 'F' UNION ALL SELECT s.* FROM ({_S}) s WHERE NOT EXISTS (SELECT 1 FROM ({_T}) t WHERE t.o_orderkey = s.o_orderkey AND t.o_orderstatus <> 'F')", covers="m_upsert_where")
def upsert_where(spark, sf):
    return M.upsert_where(_target(spark, sf), _source(spark, sf), ["o_orderkey"], F.col("o_orderstatus") == "F")


def _parts(spark, sf):
    return M.canonical_map(load(spark, sf, "part"), "p_partkey", ["p_brand", "p_type", "p_size"], [F.col("p_retailprice").desc(), F.col("p_partkey")])


_MAP = "(SELECT p_partkey AS loser, first_value(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_retailprice DESC, p_partkey) AS winner FROM part QUALIFY loser <> winner)"


@query("canonical_map", f"SELECT * FROM {_MAP}", covers="w_rn_dedup j_self_canonical")
def canonical_map(spark, sf):
    return _parts(spark, sf)


@query(
    "consolidate",
    f"""SELECT coalesce(winner, l_partkey) AS l_partkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN {_MAP} m ON m.loser = l_partkey GROUP BY 1""",
    covers="m_update_from_map m_calendar_consolidate",
)
def consolidate(spark, sf):
    """Applied twice: the second application changes nothing, as no winner is a loser."""
    mapping = _parts(spark, sf)
    once = M.update_from_map(load(spark, sf, "lineitem").select("l_partkey", "l_quantity"), "l_partkey", mapping)
    twice = M.update_from_map(once, "l_partkey", mapping)
    return twice.groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "tombstone_restore",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 's1' WHEN o_totalprice > 300000 AND o_orderstatus <> 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 's3' END AS deleted_at FROM orders",
    covers="m_tombstone m_restore m_tomb_returning",
)
def tombstone_restore(spark, sf):
    o = load(spark, sf, "orders").withColumn("deleted_at", F.lit(None).cast("string"))
    o = M.tombstone(o, F.col("o_orderstatus") == "F", "s1")
    o = M.tombstone(o, F.col("o_orderpriority") == "1-URGENT", "s3")
    o = M.tombstone(o, (F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "O"), "s2")
    big = (F.col("deleted_at") == "s3") & (F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") != "P")
    o = o.withColumn("deleted_at", F.when(big, "s2").otherwise(F.col("deleted_at")))
    return M.restore(o, "s2").select("o_orderkey", "deleted_at")


@query(
    "compare_and_set",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 1 THEN 'done' ELSE o_orderstatus END AS o_orderstatus, (o_orderkey % 3 + CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 1 THEN 1 ELSE 0 END)::BIGINT AS revision FROM orders""",
    covers="m_cas",
)
def compare_and_set(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 3).alias("revision"))
    changes = load(spark, sf, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(1).cast("long").alias("revision"), F.lit("done").alias("o_orderstatus"))
    return M.compare_and_set(rows, changes, "o_orderkey", "revision", ["o_orderstatus"])


@query(
    "merge_entities",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey = 9 THEN 3 ELSE l_suppkey END AS l_suppkey FROM lineitem WHERE l_suppkey <> 9
      OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)""",
    covers="m_merge_entities",
)
def merge_entities(spark, sf):
    return M.merge_entities(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").withColumn("l_suppkey", F.col("l_suppkey").cast("string")), "l_suppkey", "l_orderkey", "3", "9").withColumn("l_suppkey", F.col("l_suppkey").cast("long"))


@query(
    "fill_gap",
    """WITH p AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS p_name FROM part),
    t AS (SELECT p_brand, p_type, arg_max(p_name, p_partkey) AS twin FROM p WHERE p_name <> '' GROUP BY 1, 2)
    SELECT p_partkey, coalesce(nullif(p_name, ''), twin, p_name) AS p_name FROM p LEFT JOIN t USING (p_brand, p_type)""",
    covers="m_fill_gap",
)
def fill_gap(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_name")).alias("p_name"))
    return M.fill_gap(p, ["p_brand", "p_type"], "p_name", ["p_partkey"]).select("p_partkey", "p_name")


_ENVELOPES = """SELECT user_id, event_id, CASE WHEN event_id % 23 = 0 THEN 'other' ELSE 'main' END AS source_id, (event_id // 400)::BIGINT AS revision,
  event_id % 397 = 0 AS finalized, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS content_hash FROM events"""


@query(
    "ingest_outcomes",
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ({_ENVELOPES})),
    r AS (
      SELECT user_id, i, source_id AS own, revision AS top, content_hash AS hash, finalized AS done, 'applied' AS outcome FROM e WHERE i = 1
      UNION ALL
      SELECT e.user_id, e.i, own, CASE WHEN o = 'applied' THEN e.revision ELSE top END, CASE WHEN o = 'applied' THEN e.content_hash ELSE hash END, done OR (own = e.source_id AND e.finalized), o
      FROM (SELECT r.*, CASE WHEN e.source_id <> own THEN 'foreign' WHEN e.revision = top AND e.content_hash = hash THEN 'already' WHEN done THEN 'final' WHEN e.revision = top THEN 'conflict' WHEN e.revision < top THEN 'stale' ELSE 'applied' END AS o,
        e.i AS ni FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) q JOIN e ON e.user_id = q.user_id AND e.i = q.ni)
    SELECT outcome, count(*) AS n FROM r GROUP BY 1""",
    covers="m_ingest",
)
def ingest_outcomes(spark, sf):
    e = load(spark, sf, "events").select(
        "user_id", "event_id", F.when(F.col("event_id") % 23 == 0, "other").otherwise("main").alias("source_id"), F.floor(F.col("event_id") / 400).cast("long").alias("revision"),
        (F.col("event_id") % 397 == 0).alias("finalized"), F.when(F.col("event_id") % 3 == 0, "a").otherwise("b").alias("content_hash"),
    )
    return M.ingest_outcomes(e, "user_id", ["event_id"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "reconcile",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_quantity > 25 THEN 'now' END AS deleted_at FROM lineitem""",
    covers="m_reconcile",
)
def reconcile(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_quantity", F.lit(None).cast("string").alias("deleted_at"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]
    return M.reconcile(li, li.where("l_quantity <= 25").select(*keys).distinct(), keys, "l_returnflag", "A", "now").select("l_orderkey", "l_linenumber", "deleted_at")


@query(
    "import_outcomes",
    """SELECT CASE WHEN t.k IS NULL THEN 'imported' WHEN t.s = i.s AND t.p = i.p THEN 'matched' WHEN t.s = '' AND t.p = i.p THEN 'filled' ELSE 'conflict' END AS outcome, count(*) AS n
    FROM (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 3 <> 0) i
    LEFT JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 2 = 0) t USING (k) GROUP BY 1""",
    covers="m_legacy_import",
)
def import_outcomes(spark, sf):
    o = load(spark, sf, "orders")
    items = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    target = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderstatus")).alias("s"), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderpriority")).alias("p"))
    return M.import_outcomes(target, items, "k", ["s", "p"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query("unchanged_skip", "SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)", covers="m_unchanged_skip")
def unchanged_skip(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return M.unchanged(d, d.where("doc_id % 2 = 0"), ["h"]).select("doc_id")


@query(
    "replace_set",
    """SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1 THEN 'gone' END AS deleted_at FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0)
    UNION ALL SELECT c_custkey, 'BUILDING', NULL FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0""",
    covers="x_replace_set",
)
def replace_set(spark, sf):
    rows = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.lit(None).cast("string").alias("deleted_at"))
    return M.replace_set(rows, rows.where("c_mktsegment = 'BUILDING' and c_custkey % 2 = 0"), "c_custkey", F.col("c_mktsegment") == "BUILDING", "gone")


@query("expire", "SELECT event_id, CASE WHEN ts + INTERVAL 5 DAY <= TIMESTAMP '2024-01-15' THEN 'expired' END AS deleted_at FROM events", covers="x_expire")
def expire(spark, sf):
    e = load(spark, sf, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"), F.lit(None).cast("string").alias("deleted_at"))
    return M.expire(e, "expires_at", F.lit("2024-01-15").cast("timestamp_ntz"), "expired").select("event_id", "deleted_at")


@query(
    "append_once",
    """SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS first_id FROM (SELECT DISTINCT 'msg:' || sha256(concat_ws(':', user_id, event_type)) AS id FROM events)""",
    covers="x_hash_id_insert x_stable_id",
)
def append_once(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_type", "ts")
    before, e = e.where("ts < timestamp_ntz '2024-01-15'").drop("ts"), e.drop("ts")
    target = M.append_once(spark.createDataFrame([], "user_id long, event_type string, id string"), before, ["user_id", "event_type"], "msg")
    return M.append_once(target, e, ["user_id", "event_type"], "msg").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("first_id"))


@query(
    "incremental_summary",
    """WITH saved AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE o_totalprice END AS stamp FROM orders WHERE o_orderdate < DATE '1997-01-01')
    SELECT o.o_custkey, count(*) FILTER (WHERE s.o_orderkey IS NULL) AS fresh, count(*) FILTER (WHERE s.o_orderkey IS NOT NULL AND s.stamp <> o.o_totalprice) = 0 AS reusable
    FROM orders o LEFT JOIN saved s ON s.o_orderkey = o.o_orderkey GROUP BY 1""",
    covers="x_incremental_summary",
)
def incremental_summary(spark, sf):
    o = load(spark, sf, "orders")
    saved = o.where("o_orderdate < date '1997-01-01'").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", 0.0).otherwise(F.col("o_totalprice")).alias("stamp"))
    j = o.select("o_custkey", "o_orderkey", "o_totalprice").join(saved, "o_orderkey", "left")
    return j.groupBy("o_custkey").agg(F.count_if(F.col("stamp").isNull()).alias("fresh"), (F.count_if(F.col("stamp") != F.col("o_totalprice")) == 0).alias("reusable"))


@query(
    "json_guarded",
    """SELECT event_type, count(*) FILTER (WHERE json_valid(x)) AS good, count(*) FILTER (WHERE NOT json_valid(x)) AS bad, sum(CASE WHEN json_valid(x) THEN CAST(x ->> '$.k' AS BIGINT) END)::BIGINT AS total
    FROM (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE props END AS x FROM events) GROUP BY 1""",
    covers="f_json_guard sf_json_valid",
)
def json_guarded(spark, sf):
    e = load(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props")).alias("x"))
    good = jsonx.valid("x")
    return e.groupBy("event_type").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.sum(F.when(good, jsonx.field("x", "$.k", "long"))).alias("total"))


@query(
    "json_set",
    """SELECT event_id, CAST(props ->> '$.k' AS BIGINT) * 2 AS k, 'yes' AS flag, false AS has_old FROM events""",
    covers="m_json_set m_json_remove m_meta_merge",
)
def json_set(spark, sf):
    """The value changes, a field is merged in, another is set and removed again."""
    k = jsonx.field("props", "$.k", "long") * 2
    e = load(spark, sf, "events").select("event_id", jsonx.with_field("props", "k", k).alias("j"))
    e = e.select("event_id", jsonx.without_field(jsonx.with_field(jsonx.merged("j", F.lit('{"flag":"yes"}')), "old", F.lit("x")), "old").alias("j"))
    return e.select("event_id", jsonx.field("j", "$.k", "long").alias("k"), jsonx.field("j", "$.flag").alias("flag"), jsonx.field("j", "$.old").isNotNull().alias("has_old"))


@query(
    "preference_backfill",
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN props ->> '$.k' END, CASE WHEN event_id % 3 = 1 THEN event_type END, 'default') AS theme FROM events""",
    covers="m_pref_backfill p_coalesce_nullif u_values",
)
def preference_backfill(spark, sf):
    new = F.when(F.col("event_id") % 3 == 0, F.col("props"))
    old = F.when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("theme"))))
    e = load(spark, sf, "events")
    return e.select("event_id", F.coalesce(jsonx.field(new, "$.k"), jsonx.field(old, "$.theme"), F.lit("default")).alias("theme"))


@query(
    "title_repair",
    """SELECT conv_id, coalesce(first(t ORDER BY turn) FILTER (WHERE lower(t) NOT IN ('', 'untitled')), '') AS title
    FROM (SELECT conv_id, turn, trim(regexp_extract('# ' || text, '(?m)^# (.{1,40})', 1)) AS t FROM conversations WHERE role <> 'system') GROUP BY 1""",
    covers="m_title_repair w_rn_first",
)
def title_repair(spark, sf):
    c = load(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn", F.trim(F.regexp_extract(F.concat(F.lit("# "), "text"), "(?m)^# (.{1,40})", 1)).alias("t"))
    return c.groupBy("conv_id").agg(F.coalesce(F.min_by("t", F.when(~F.lower("t").isin("", "untitled"), F.col("turn"))), F.lit("")).alias("title"))


@query("changed_entities", "SELECT user_id, max(event_id) AS generation, coalesce(max(event_id) FILTER (WHERE event_type = 'view'), -1) AS acknowledged FROM events GROUP BY 1 HAVING generation > acknowledged", covers="fts_incremental s_cdc")
def changed_entities(spark, sf):
    e = load(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("generation"), F.coalesce(F.max(F.when(F.col("event_type") == "view", F.col("event_id"))), F.lit(-1)).alias("acknowledged"))
    return e.where("generation > acknowledged")


@query(
    "index_consistency",
    """SELECT count(*) AS active, (SELECT count(*) FROM documents WHERE doc_id % 100 <> 7) AS indexed, count(*) <> (SELECT count(*) FROM documents WHERE doc_id % 100 <> 7) AS rebuild FROM documents""",
    covers="fts_consistency a_count",
)
def index_consistency(spark, sf):
    d = load(spark, sf, "documents").agg(F.count("*").alias("active"), F.count_if(F.col("doc_id") % 100 != 7).alias("indexed"))
    return d.withColumn("rebuild", F.col("active") != F.col("indexed"))
