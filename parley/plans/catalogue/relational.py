"""Filters, joins, sets, sorts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators import relational as R
from parley.plans.catalog import query
from parley.sources.tables import load


def _recent():
    return [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc_nulls_last()]


@query(
    "recent_sessions",
    """SELECT o_orderkey, o_orderdate, coalesce(nullif(c_name, ''), 'Unknown') AS person, coalesce(nullif(n_name, ''), 'Unknown') AS organisation
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
    WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST LIMIT 50 OFFSET 10""",
    covers="o_multi j_left_chain p_coalesce_nullif o_limit_offset f_active",
)
def recent_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The page is cut before the joins, which then meet 50 rows only: left joins on unique keys neither drop nor repeat rows."""
    orders = load(spark, sf, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderdate", "o_custkey")
    top = R.page(orders, _recent(), 50, 10)
    c, n = load(spark, sf, "customer"), load(spark, sf, "nation")
    j = top.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    unknown = F.lit("Unknown")
    return j.select("o_orderkey", "o_orderdate", F.coalesce(R.filled("c_name"), unknown).alias("person"), F.coalesce(R.filled("n_name"), unknown).alias("organisation")).orderBy(*_recent())


@query("session_search", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE instr(lower(c_name), '00001') > 0 OR instr(lower(c_mktsegment), 'build') > 0", covers="f_substr_ci")
def session_search(spark, sf):
    c = load(spark, sf, "customer")
    return c.where(R.contains_ci("c_name", "00001") | R.contains_ci("c_mktsegment", "BUILD")).select("c_custkey", "c_name", "c_mktsegment")


@query(
    "contact_search",
    "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE lower(concat_ws(chr(10), c_name, c_mktsegment, n_name)) LIKE '%1\nmach%n_1%'",
    covers="f_like_concat",
)
def contact_search(spark, sf):
    j = load(spark, sf, "customer").join(F.broadcast(load(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.where(R.like_any(["c_name", "c_mktsegment", "n_name"], "1\nMACH%N_1")).select("c_custkey", "c_name", "n_name")


@query("optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')", covers="f_optional f_in_list f_term_exact")
def optional_filters(spark, sf):
    o = load(spark, sf, "orders")
    return o.where(R.optional_equal("o_orderstatus", "P") & R.optional_equal("o_custkey", "") & R.in_list("o_orderpriority", ["2-HIGH", "1-URGENT", "2-HIGH"])).select("o_orderkey")


@query("empty_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN (NULL)", covers="f_in_list")
def empty_list(spark, sf):
    return load(spark, sf, "orders").where(R.in_list("o_orderpriority", [])).select("o_orderkey")


@query("json_id_list", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT CAST(unnest(from_json('[1,5,9,700]', '[\"BIGINT\"]')) AS BIGINT))", covers="f_in_json")
def json_id_list(spark, sf):
    ids = spark.range(1).select(F.explode(F.from_json(F.lit("[1,5,9,700]"), "array<long>")).alias("c_custkey"))
    return load(spark, sf, "customer").join(F.broadcast(ids), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("prefix_match", "SELECT p_partkey, p_name FROM part WHERE p_name GLOB 'red*' OR p_type LIKE 'STAND%'", covers="f_glob f_prefix_like")
def prefix_match(spark, sf):
    return load(spark, sf, "part").where(F.col("p_name").startswith("red") | F.col("p_type").startswith("STAND")).select("p_partkey", "p_name")


_NOW = "2024-01-15 12:00:00"


@query(
    "nearby_events",
    f"""SELECT event_id, ts, abs(epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '{_NOW}') // 1000) AS distance_ms FROM events
    WHERE abs(epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '{_NOW}') // 1000) <= 3600000 ORDER BY 3, ts, event_id""",
    covers="f_abs_window j_nearest",
)
def nearby_events(spark, sf):
    """The window is also given as a range of ts, which reaches the scan."""
    e = load(spark, sf, "events").where(f"ts >= timestamp_ntz'{_NOW}' - INTERVAL 1 HOUR AND ts <= timestamp_ntz'{_NOW}' + INTERVAL 1 HOUR + INTERVAL 1 SECOND")
    distance = F.abs(F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit(_NOW).cast("timestamp")))
    return e.select("event_id", "ts", distance.alias("distance_ms")).where("distance_ms <= 3600000").orderBy("distance_ms", "ts", "event_id")


@query("time_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'", covers="f_range_dt")
def time_range(spark, sf):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return load(spark, sf, "events").where(R.date_range("ts", gte=stamp("2024-01-10"), gt=stamp("2024-01-10 12:00:00"), lt=stamp("2024-01-11"))).select("event_id")


@query("facet_filter", "SELECT doc_id, source FROM documents WHERE concat('/', lang, '/', source) = '/en' OR starts_with(concat('/', lang, '/', source), '/en/src1')", covers="f_facet")
def facet_filter(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", F.array(F.concat(F.lit("/"), "lang", F.lit("/"), "source")).alias("facets"))
    return d.where(F.exists("facets", lambda f: (f == "/en") | f.startswith("/en/src1"))).select("doc_id", "source")


@query("sessions_with_parts", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", covers="j_semi j_inner_chain")
def sessions_with_parts(spark, sf):
    r = load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf, "orders").join(r, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("sessions_without_parts", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", covers="j_anti")
def sessions_without_parts(spark, sf):
    r = load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf, "orders").join(r, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query(
    "self_excluded",
    """SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (
      SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 UNION SELECT s_suppkey FROM supplier WHERE s_nationkey = 3
      UNION SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R' AND l_discount = 0)""",
    covers="j_anti_notin_union u_union_distinct",
)
def self_excluded(spark, sf):
    s, li = load(spark, sf, "supplier"), load(spark, sf, "lineitem")
    gone = li.where("l_quantity > 49 and l_returnflag = 'R' and l_discount = 0").select("l_suppkey")
    return R.anti_all(li.select("l_suppkey").distinct(), "l_suppkey", s.where("s_acctbal < 0").select("s_suppkey"), s.where("s_nationkey = 3").select("s_suppkey"), gone)


@query(
    "linked_event",
    """SELECT event_id, min(c_custkey) AS c_custkey FROM events JOIN (SELECT c_custkey, c_nationkey, length(c_mktsegment) - 4 AS seg FROM customer) c
    ON c_custkey = user_id OR (c_nationkey = user_id % 25 AND seg = length(event_type)) GROUP BY event_id""",
    covers="j_disjunctive j_scalar_first",
)
def linked_event(spark, sf):
    """Each leg's smallest customer by key comes before the join, so neither leg makes pairs."""
    e = load(spark, sf, "events").select("event_id", "user_id", (F.col("user_id") % 25).cast("int").alias("nation"), F.length("event_type").alias("kind"))
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.length("c_mktsegment") - 4).alias("seg"))
    first = c.groupBy("c_nationkey", "seg").agg(F.min("c_custkey").alias("c_custkey"))
    one = e.join(c.select("c_custkey"), e["user_id"] == c["c_custkey"]).select("event_id", "c_custkey")
    two = e.join(first, (F.col("nation") == F.col("c_nationkey")) & (F.col("kind") == F.col("seg"))).select("event_id", "c_custkey")
    return one.unionByName(two).groupBy("event_id").agg(F.min("c_custkey").alias("c_custkey"))


@query(
    "latest_per_customer",
    """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    covers="j_latest_per_group",
)
def latest_per_customer(spark, sf):
    return R.latest_per_group(load(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


_SIDE = "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '{}' AND ts < TIMESTAMP '{}' GROUP BY 1, 2"


@query(
    "event_diff",
    f"""WITH a AS ({_SIDE.format("2024-01-15", "2024-01-16")}), b AS ({_SIDE.format("2024-01-14", "2024-01-15 12:00:00")})
    SELECT action, count(*) AS n FROM (SELECT CASE WHEN b.n IS NULL THEN 'add' WHEN a.n IS NULL THEN 'delete'
      WHEN a.n <> b.n OR a.first_id <> b.first_id THEN 'update' ELSE 'same' END AS action FROM a FULL JOIN b USING (user_id, event_type)) GROUP BY 1""",
    covers="j_hash_diff j_participant_diff",
)
def event_diff(spark, sf):
    def side(lo: str, hi: str) -> DataFrame:
        e = load(spark, sf, "events").where(f"ts >= timestamp_ntz'{lo}' and ts < timestamp_ntz'{hi}'")
        return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))

    diff = R.hash_diff(side("2024-01-15", "2024-01-16"), side("2024-01-14", "2024-01-15 12:00:00"), ["user_id", "event_type"], ["n", "first_id"])
    return diff.groupBy("action").agg(F.count("*").alias("n"))


@query(
    "participant_diff",
    """WITH i AS (SELECT lower(trim(c_name)) AS email, min(c_custkey) AS who FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1),
    m AS (SELECT lower(trim(c_name)) AS email, CASE WHEN c_custkey % 2 = 0 THEN 'auto' ELSE 'manual' END AS source FROM customer WHERE c_custkey % 5 <> 0)
    SELECT email, CASE WHEN m.email IS NULL THEN 'add' WHEN i.email IS NULL AND source = 'auto' THEN 'delete' ELSE 'keep' END AS action FROM i FULL JOIN m USING (email)""",
    covers="j_participant_diff",
)
def participant_diff(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", F.lower(F.trim("c_name")).alias("email"))
    incoming = c.where("c_custkey % 3 <> 0").select("email", F.lit(True).alias("here")).distinct()
    mapped = c.where("c_custkey % 5 <> 0").select("email", F.when(F.col("c_custkey") % 2 == 0, "auto").otherwise("manual").alias("source"))
    j = incoming.join(mapped, "email", "full_outer")
    return j.select("email", F.when(F.col("source").isNull(), "add").when(F.col("here").isNull() & (F.col("source") == "auto"), "delete").otherwise("keep").alias("action"))


@query(
    "shared_participant",
    """SELECT l_orderkey, count(DISTINCT l_partkey) AS shared FROM lineitem WHERE l_orderkey <> 7 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 7) GROUP BY 1""",
    covers="j_jaccardless_share",
)
def shared_participant(spark, sf):
    """Orders that share a part with one order, a session that a user looks at; the filter on that order reaches the scan."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    own = li.where("l_orderkey = 7").select("l_partkey").distinct()
    return li.where("l_orderkey <> 7").join(own, "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("shared"))


@query(
    "nearest_order",
    """SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1998-06-01')), o_orderkey) AS rn
    FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rn = 1""",
    covers="j_nearest",
)
def nearest_order(spark, sf):
    o = load(spark, sf, "orders")
    distance = F.abs(F.unix_millis(F.col("o_orderdate").cast("timestamp")) - F.unix_millis(F.lit("1998-06-01").cast("timestamp")))
    near = o.groupBy("o_custkey").agg(F.min(F.struct(distance.alias("d"), "o_orderkey"))["o_orderkey"].alias("o_orderkey"))
    c = load(spark, sf, "customer").select("c_custkey")
    return c.join(near, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query(
    "owner_priority",
    """SELECT who, priority FROM (SELECT c_name AS who, 1 AS priority, c_acctbal AS score, c_custkey AS id FROM customer WHERE c_acctbal > 1e9
      UNION ALL SELECT s_name, 2, s_acctbal, s_suppkey FROM supplier UNION ALL SELECT n_name, 3, 0.0, n_nationkey FROM nation)
    ORDER BY priority, score DESC, id LIMIT 1""",
    covers="o_union_priority u_union_all u_values",
)
def owner_priority(spark, sf):
    parts = [
        load(spark, sf, "customer").where("c_acctbal > 1e9").select(F.col("c_name").alias("who"), F.lit(1).alias("priority"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("id")),
        load(spark, sf, "supplier").select(F.col("s_name").alias("who"), F.lit(2).alias("priority"), F.col("s_acctbal").alias("score"), F.col("s_suppkey").alias("id")),
        load(spark, sf, "nation").select(F.col("n_name").alias("who"), F.lit(3).alias("priority"), F.lit(0.0).alias("score"), F.col("n_nationkey").cast("long").alias("id")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("priority", F.col("score").desc(), "id").limit(1).select("who", "priority")


@query(
    "page_plus_one",
    """SELECT c_custkey, c_name, true AS has_more, 60 AS next_offset FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40""",
    covers="o_page_plus1",
)
def page_plus_one(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return R.page_with_more(c, [F.col("c_acctbal").desc(), F.col("c_custkey")], 20, 40).drop("c_acctbal")


@query("bool_order", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus = 'F', o_orderdate, o_orderkey LIMIT 25", covers="o_bool")
def bool_order(spark, sf):
    return load(spark, sf, "orders").orderBy(F.col("o_orderstatus") == "F", "o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderstatus")


@query(
    "word_page",
    """SELECT conv_id, turn, word FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '\\s+')) AS word, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS pos FROM conversations)
    WHERE word <> '' ORDER BY conv_id, turn, pos LIMIT 200 OFFSET 300""",
    covers="o_word_page",
)
def word_page(spark, sf):
    t = load(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\s+")).alias("pos", "word")).where("word <> ''")
    return t.orderBy("conv_id", "turn", "pos").offset(300).limit(200).select("conv_id", "turn", "word")


@query(
    "tail_capped",
    """SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE strlen(text) <= 600) WHERE rn <= 3 ORDER BY conv_id, turn""",
    covers="x_tail_capped",
)
def tail_capped(spark, sf):
    c = load(spark, sf, "conversations").where(F.octet_length("text") <= 600)
    return R.first_per_group(c, ["conv_id"], [F.col("turn").desc()], 3).select("conv_id", "turn", "text").orderBy("conv_id", "turn")


@query(
    "orphans",
    """SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)""",
    covers="u_subtract_orphans",
)
def orphans(spark, sf):
    live = load(spark, sf, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    return load(spark, sf, "lineitem").select("l_partkey").distinct().join(live, "l_partkey", "left_anti")


@query(
    "max_of_union",
    "SELECT max(k) + 1 AS next_order FROM (SELECT max(c_custkey) AS k FROM customer UNION ALL SELECT max(s_suppkey) FROM supplier)",
    covers="a_max_union",
)
def max_of_union(spark, sf):
    a = load(spark, sf, "customer").select(F.max("c_custkey").alias("k")).unionByName(load(spark, sf, "supplier").select(F.max("s_suppkey").alias("k")))
    return a.select((F.max("k") + 1).alias("next_order"))


@query(
    "related_sessions",
    """WITH me AS (SELECT o_orderkey, o_custkey, o_orderdate, c_mktsegment, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey),
    r AS (SELECT a.o_orderkey AS id, b.o_orderkey AS other, b.o_orderdate AS when_, CASE WHEN a.o_custkey = b.o_custkey THEN 3 WHEN a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment THEN 2 END AS rank
      FROM me a JOIN me b ON b.o_orderdate < a.o_orderdate AND (a.o_custkey = b.o_custkey OR (a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment)) WHERE a.o_orderkey = 7)
    SELECT id, other, rank, row_number() OVER (PARTITION BY id ORDER BY rank DESC, when_ DESC, other DESC) AS place FROM r QUALIFY place <= 8""",
    covers="pn_related o_rank_topk p_rank",
)
def related_sessions(spark, sf):
    """Earlier sessions related to one that a user looks at: each key is an equi-join of its own, the best rank of a pair a grouped maximum, and 8 are kept."""
    me = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_custkey", "o_orderdate", "c_mktsegment", "c_nationkey")
    mine = me.where("o_orderkey = 7").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("mine_at"), "o_custkey", "c_mktsegment", "c_nationkey")
    other = me.select(F.col("o_orderkey").alias("other"), F.col("o_orderdate").alias("at"), "o_custkey", "c_mktsegment", "c_nationkey")
    found = None
    for rank, keys in ((3, ["o_custkey"]), (2, ["c_nationkey", "c_mktsegment"])):
        one = mine.select("id", "mine_at", *keys).join(other.select("other", "at", *keys), keys).where("at < mine_at").select("id", "other", "at", F.lit(rank).alias("rank"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("id", "other", "at").agg(F.max("rank").alias("rank"))
    w = Window.partitionBy("id").orderBy(F.col("rank").desc(), F.col("at").desc(), F.col("other").desc())
    return best.withColumn("place", F.row_number().over(w)).where("place <= 8").select("id", "other", "rank", "place")


@query(
    "fallback_lookup",
    """SELECT coalesce((SELECT c_name FROM customer WHERE c_custkey = -1), (SELECT s_name FROM supplier WHERE s_suppkey = 3), (SELECT n_name FROM nation WHERE n_nationkey = 1)) AS name""",
    covers="x_fallback_lookup",
)
def fallback_lookup(spark, sf):
    rows = [
        load(spark, sf, "customer").where("c_custkey = -1").select(F.lit(1).alias("p"), F.col("c_name").alias("name")),
        load(spark, sf, "supplier").where("s_suppkey = 3").select(F.lit(2).alias("p"), F.col("s_name").alias("name")),
        load(spark, sf, "nation").where("n_nationkey = 1").select(F.lit(3).alias("p"), F.col("n_name").alias("name")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("p"))).alias("name"))


@query(
    "join_on_json",
    """SELECT event_id, p_partkey FROM events JOIN part ON CAST(props ->> '$.k' AS BIGINT) = p_size AND length(p_brand) = length(event_type) + 4
    UNION ALL SELECT event_id, p_partkey FROM events JOIN part ON CAST(props ->> '$.k' AS BIGINT) = p_partkey AND event_type = 'view'""",
    covers="x_join_on_json f_json_guard",
)
def join_on_json(spark, sf):
    """Sizes are few, so the first leg's result grows with the square of the input."""
    from parley.functions.jsonx import field

    e = load(spark, sf, "events").select("event_id", "event_type", F.length("event_type").alias("kind"), field("props", "$.k", "long").alias("k")).where("k is not null")
    p = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("k"), (F.length("p_brand") - 4).alias("kind"))
    a = R.dense_join(e, p, ["k", "kind"], "event_id", "p_partkey")
    b = e.where("event_type = 'view'").join(p.select("p_partkey"), F.col("k") == F.col("p_partkey"))
    return a.unionByName(b.select("event_id", "p_partkey"))


@query(
    "empty_sessions",
    """SELECT c_custkey FROM customer c WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') = 0
    AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) = 0 AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') = 0""",
    covers="f_not_content in_empty a_exists_flags",
)
def empty_sessions(spark, sf):
    """One grouped pass over the children in place of a correlated count for each kind."""
    kinds = {"open": "o_orderstatus = 'O'", "big": "o_totalprice > 400000", "urgent": "o_orderpriority = '1-URGENT'"}
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(*[F.max(F.expr(e)).alias(k) for k, e in kinds.items()])
    some = o.where(" or ".join(kinds)).select("c_custkey")
    return load(spark, sf, "customer").join(some, "c_custkey", "left_anti").select("c_custkey")


@query(
    "activity_policy",
    """SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN 'ignored' WHEN user_id % 10 = 0 THEN 'included' WHEN event_type IN ('view', 'click') THEN 'default' ELSE 'other' END AS verdict
    FROM (SELECT DISTINCT user_id, event_type FROM events)""",
    covers="f_mic_policy",
)
def activity_policy(spark, sf):
    verdict = F.when(F.col("event_type") == "error", "ignored").when(F.col("user_id") % 10 == 0, "included").when(F.col("event_type").isin("view", "click"), "default").otherwise("other")
    return load(spark, sf, "events").select("user_id", "event_type").distinct().withColumn("verdict", verdict)
