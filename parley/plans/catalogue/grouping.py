"""Aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import jsonx
from parley.operators import intervals as I
from parley.operators import relational as R
from parley.plans.catalog import query
from parley.sources.tables import load

_HOUR = 3_600_000


@query(
    "run_rollup",
    """SELECT l_returnflag, count(*) AS items, coalesce(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END), 0)::BIGINT AS done, round(sum(l_extendedprice), 2) AS price,
      CASE WHEN sum(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) > 0 THEN 'partial' WHEN sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = count(*) THEN 'completed' ELSE 'running' END AS status
    FROM lineitem GROUP BY 1""",
    covers="a_sum_cond m_run_rollup a_count",
)
def run_rollup(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("items"), F.coalesce(F.count_if(F.col("l_linestatus") == "F"), F.lit(0)).alias("done"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count_if(F.col("l_discount") > 0.09).alias("failed")
    )
    status = F.when(F.col("failed") > 0, "partial").when(F.col("done") == F.col("items"), "completed").otherwise("running")
    return li.select("l_returnflag", "items", "done", "price", status.alias("status"))


@query(
    "most_common",
    "SELECT l_suppkey, l_returnflag FROM (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1",
    covers="a_group_mode",
)
def most_common(spark, sf):
    n = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return n.groupBy("l_suppkey").agg(F.min_by("l_returnflag", F.struct((-F.col("n")).alias("n"), "l_returnflag")).alias("l_returnflag"))


@query("distinct_composite", "SELECT count(DISTINCT concat_ws(':', user_id, event_type)) AS n, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS some FROM events", covers="a_count_distinct a_distinct")
def distinct_composite(spark, sf):
    e = load(spark, sf, "events")
    return e.agg(F.countDistinct(F.concat_ws(":", "user_id", "event_type")).alias("n"), F.countDistinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("some"))


@query(
    "nested_children",
    """SELECT o_custkey, '[' || string_agg('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS children,
      string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS priorities FROM orders GROUP BY 1""",
    covers="a_collect_json a_group_concat",
)
def nested_children(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderpriority")))
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(rows.alias("r"))
    return o.select("o_custkey", F.to_json(F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["status"].alias("status")))).alias("children"), F.array_join(F.transform("r", lambda x: x["o_orderpriority"]), " ").alias("priorities"))


@query(
    "multi_channel",
    """SELECT event_type, count(DISTINCT user_id) > 1 AS multi, count(DISTINCT user_id) > 1 OR count(DISTINCT CAST(props ->> '$.k' AS BIGINT) % 3) > 1 OR count(DISTINCT value > 50) > 1 AS separated FROM events GROUP BY 1""",
    covers="a_set_pair a_separation",
)
def multi_channel(spark, sf):
    e = load(spark, sf, "events").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct(jsonx.field("props", "$.k", "long") % 3).alias("ks"), F.countDistinct(F.col("value") > 50).alias("levels")
    )
    return e.select("event_type", (F.col("users") > 1).alias("multi"), F.greatest("users", "ks", "levels").__gt__(1).alias("separated"))


@query(
    "only_candidate",
    "SELECT p_brand, p_type, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS only_part, max(p_retailprice) - min(p_retailprice) AS spread, min(nullif(p_name, '')) AS first_name FROM part GROUP BY 1, 2",
    covers="a_count1_min a_minmax a_duration",
)
def only_candidate(spark, sf):
    return load(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        F.when(F.count("*") == 1, F.min("p_partkey")).alias("only_part"), (F.max("p_retailprice") - F.min("p_retailprice")).alias("spread"), F.min(R.filled("p_name")).alias("first_name")
    )


@query(
    "worst_quality",
    "SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) WHEN 2 THEN 'mixed' WHEN 1 THEN 'synthetic' ELSE 'provider' END AS worst FROM events WHERE value > 20 GROUP BY 1",
    covers="a_worst",
)
def worst_quality(spark, sf):
    rank = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    e = load(spark, sf, "events").where("value > 20").groupBy("user_id").agg(F.max(rank).alias("r"))
    return e.select("user_id", F.element_at(F.array(F.lit("provider"), F.lit("synthetic"), F.lit("mixed")), F.col("r") + 1).alias("worst"))


@query(
    "fingerprints",
    """SELECT conv_id, sha256(string_agg(concat_ws(chr(31), role, text), chr(31) ORDER BY turn)) AS fingerprint, count(*) AS turns FROM conversations GROUP BY 1""",
    covers="a_fingerprint",
)
def fingerprints(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("\x1f", "role", "text").alias("t"))))
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(rows.alias("r"), F.count("*").alias("turns"))
    return c.select("conv_id", F.sha2(F.array_join(F.transform("r", lambda x: x["t"]), "\x1f").cast("binary"), 256).alias("fingerprint"), "turns")


@query(
    "audit",
    """WITH a AS (SELECT user_id, count(*) AS n, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS f FROM events WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1),
    b AS (SELECT user_id, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS f FROM events WHERE ts < TIMESTAMP '2024-01-02 01:00:00' AND user_id % 7 <> 0 GROUP BY 1)
    SELECT user_id, CASE WHEN b.f IS NULL THEN 'missing' WHEN a.f IS NULL THEN 'orphan' WHEN a.f = b.f THEN 'current' ELSE 'stale' END AS state FROM a FULL JOIN b USING (user_id)""",
    covers="audit sink_md_mirror",
)
def audit(spark, sf):
    def side(where: str, name: str):
        ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
        return load(spark, sf, "events").where(where).groupBy("user_id").agg(F.sha2(ids, 256).alias(name))

    a, b = side("ts < timestamp_ntz'2024-01-02'", "a"), side("ts < timestamp_ntz'2024-01-02 01:00:00' and user_id % 7 <> 0", "b")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").when(F.col("a") == F.col("b"), "current").otherwise("stale")
    return a.join(b, "user_id", "full_outer").select("user_id", state.alias("state"))


_RUNS = """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_id FROM events),
r AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM r),
runs AS (SELECT user_id, run, min(t) AS "start", max(t) AS "end", count(*) AS n FROM s GROUP BY 1, 2)"""


def _events(spark, sf):
    return load(spark, sf, "events").withColumn("t", F.unix_millis(F.col("ts").cast("timestamp")))


def _runs(spark, sf):
    return I.runs(_events(spark, sf), ["user_id"], F.col("t"), F.col("t"), 6 * _HOUR, ["event_id"])


@query("activity_runs", _RUNS + ' SELECT user_id, run, "start", "end", n FROM runs', covers="w_runs w_gapseg")
def activity_runs(spark, sf):
    return _runs(spark, sf)


@query(
    "top3_runs",
    _RUNS + """ SELECT user_id, "start", "end", rn AS rank, least(("end" - "start") / 36000000.0, 1.0) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "end" - "start" DESC, "start") AS rn FROM runs WHERE n > 1) WHERE rn <= 3""",
    covers="w_topn_group",
)
def top3_runs(spark, sf):
    top = I.longest(_runs(spark, sf).where("n > 1"), ["user_id"], 3)
    return top.select("user_id", "start", "end", "rank", F.least((F.col("end") - F.col("start")) / F.lit(36000000.0), F.lit(1.0)).alias("quality"))


@query(
    "overlap_cut",
    """WITH e AS (SELECT event_type AS channel, user_id % 4 AS speaker, epoch_us(ts) // 1000 AS s, event_id FROM events),
    r AS (SELECT *, CASE WHEN s - max(s + 5400000) OVER (PARTITION BY channel, speaker ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS new FROM e),
    g AS (SELECT *, sum(new) OVER (PARTITION BY channel, speaker ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r),
    i AS (SELECT channel, speaker, min(s) AS s, max(s) + 5400000 AS e FROM g GROUP BY channel, speaker, run),
    p AS (SELECT DISTINCT channel, s AS x FROM i UNION SELECT channel, e FROM i),
    q AS (SELECT channel, x AS a, lead(x) OVER (PARTITION BY channel ORDER BY x) AS b FROM p),
    c AS (SELECT q.channel, a, b, min(speaker) AS speaker FROM q JOIN i ON i.channel = q.channel AND i.s <= a AND i.e >= b WHERE b IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1),
    n AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY channel, speaker ORDER BY a) = a THEN 0 ELSE 1 END AS new FROM c),
    m AS (SELECT *, sum(new) OVER (PARTITION BY channel, speaker ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM n)
    SELECT channel, speaker, min(a) AS "start", max(b) AS "end" FROM m GROUP BY channel, speaker, run""",
    covers="j_interval_subtract",
)
def overlap_cut(spark, sf):
    e = _events(spark, sf).select(F.col("event_type").alias("channel"), (F.col("user_id") % 4).alias("speaker"), "t")
    own = I.runs(e, ["channel", "speaker"], F.col("t"), F.col("t") + 5_400_000, 0).select("channel", "speaker", "start", "end")
    return I.alone(own, ["channel"], "speaker")


@query(
    "speaker_spans",
    r"""WITH t AS (SELECT conv_id AS transcript, turn, unnest(string_split_regex(trim(text), '\s+')) AS x, generate_subscripts(string_split_regex(trim(text), '\s+'), 1) - 1 AS pos FROM conversations),
    w AS (SELECT transcript, (pos // 60) % 2 AS speaker, turn * 900000 + pos * 300 + (pos // 25) * 500 AS s, turn * 900000 + pos * 300 + (pos // 25) * 500 + CASE WHEN pos % 45 = 44 THEN 2900 ELSE 250 END AS e FROM t),
    r AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY transcript, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 400 THEN 0 ELSE 1 END AS new FROM w),
    g AS (SELECT *, sum(new) OVER (PARTITION BY transcript, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM r),
    i AS MATERIALIZED (SELECT transcript, speaker, min(s) AS s, max(e) AS e FROM g GROUP BY transcript, speaker, run),
    p AS (SELECT DISTINCT transcript, s AS x FROM i UNION SELECT transcript, e FROM i),
    q AS (SELECT transcript, x AS a, lead(x) OVER (PARTITION BY transcript ORDER BY x) AS b FROM p),
    c AS (SELECT q.transcript, a, b, min(speaker) AS speaker FROM q JOIN i ON i.transcript = q.transcript AND i.s <= a AND i.e >= b WHERE b IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1),
    n AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY transcript, speaker ORDER BY a) = a THEN 0 ELSE 1 END AS new FROM c),
    m AS (SELECT *, sum(new) OVER (PARTITION BY transcript, speaker ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM n),
    k AS (SELECT transcript, speaker, min(a) AS s, max(b) AS e FROM m GROUP BY transcript, speaker, run),
    l AS (SELECT transcript, speaker, s + greatest(e - s - 10000, 0) // 2 AS s, least(e, s + greatest(e - s - 10000, 0) // 2 + 10000) AS e FROM k),
    o AS (SELECT *, row_number() OVER (PARTITION BY transcript, speaker ORDER BY e - s DESC, s) AS rank FROM l WHERE e - s >= 1500)
    SELECT transcript, speaker, s AS "start", e AS "end", rank, least((e - s) / 10000.0, 1.0) AS quality FROM o WHERE rank <= 3""",
    covers="vp_spans",
)
def speaker_spans(spark, sf):
    """Words of two speakers who interrupt each other: the three longest stretches of each alone, 1.5 to 10 seconds of them."""
    c = load(spark, sf, "conversations").select(F.col("conv_id").alias("transcript"), F.col("turn").cast("long").alias("turn"), F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "x"))
    start = (F.col("turn") * 900_000 + F.col("pos") * 300 + F.floor(F.col("pos") / 25) * 500).cast("long")
    words = c.select("transcript", (F.floor(F.col("pos") / 60) % 2).alias("speaker"), start.alias("start_ms"), (start + F.when(F.col("pos") % 45 == 44, 2900).otherwise(250)).alias("end_ms"))
    return I.speaker_spans(words, ["transcript"], "speaker")


@query(
    "first_seen_rank",
    "SELECT user_id, event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY min(event_id)) AS label FROM events GROUP BY 1, 2",
    covers="w_dense_label s_label",
)
def first_seen_rank(spark, sf):
    first = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.select("user_id", "event_type", F.dense_rank().over(Window.partitionBy("event_type").orderBy("first")).alias("label"))


@query(
    "context_window",
    """SELECT event_id, string_agg(event_type, ' ') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS context FROM events""",
    covers="w_context",
)
def context_window(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-6, 6)
    return load(spark, sf, "events").select("event_id", F.array_join(F.collect_list("event_type").over(w), " ").alias("context"))


@query(
    "drop_repeats",
    """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""",
    covers="w_lag_distinct a_mean_state s_accumulate",
)
def drop_repeats(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf, "events").withColumn("before", F.lag("event_type").over(w))
    return e.where("before is null or before <> event_type").select("event_id", "user_id", "event_type")


@query(
    "batch_state",
    """SELECT user_id, round(avg(value) FILTER (WHERE isfinite(value)), 6) AS mean_value, max(value) AS top, count(*) AS n FROM events GROUP BY 1""",
    covers="a_mean_state s_accumulate",
)
def batch_state(spark, sf):
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return load(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg(finite), 6).alias("mean_value"), F.max("value").alias("top"), F.count("*").alias("n"))


@query(
    "first_title",
    """SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) < 30, turn) AS rn FROM conversations WHERE role <> 'system') WHERE rn = 1""",
    covers="w_rn_first w_rn_expr",
)
def first_title(spark, sf):
    c = load(spark, sf, "conversations").where("role <> 'system'")
    return c.groupBy("conv_id").agg(F.min_by("text", F.struct((F.length("text") < 30).alias("short"), "turn")).alias("text"))


@query(
    "best_and_second",
    """WITH m AS (SELECT l_suppkey, l_partkey, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY top DESC, l_partkey) AS rn FROM m)
    SELECT a.l_suppkey, a.l_partkey AS best, a.top AS best_score, b.top AS second_score FROM r a LEFT JOIN r b ON b.l_suppkey = a.l_suppkey AND b.rn = 2 WHERE a.rn = 1""",
    covers="w_best_second",
)
def best_and_second(spark, sf):
    m = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("top"))
    w = Window.partitionBy("l_suppkey").orderBy(F.col("top").desc(), "l_partkey")
    r = m.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return r.groupBy("l_suppkey").agg(F.max(F.when(F.col("rn") == 1, F.col("l_partkey"))).alias("best"), F.max(F.when(F.col("rn") == 1, F.col("top"))).alias("best_score"), F.max(F.when(F.col("rn") == 2, F.col("top"))).alias("second_score"))


@query(
    "rollup_levels",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    covers="a_rollup a_grouping_sets",
)
def rollup_levels(spark, sf):
    return load(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("cube_levels", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", covers="a_cube")
def cube_levels(spark, sf):
    return load(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "set_operations",
    """(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 5000""",
    covers="intersect_except src_sql",
)
def set_operations(spark, sf):
    from parley.sources.sql import Catalog

    return Catalog(spark, sf, ["orders", "customer"]).execute(
        "SELECT * FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = ? INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = ?) EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 5000", ["O", "P"]
    )


@query(
    "ranks_and_frames",
    """SELECT o_orderkey, rank() OVER w AS r, lag(o_totalprice) OVER w AS before, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three, ntile(4) OVER w AS quarter
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    covers="src_sql ranking_frames",
)
def ranks_and_frames(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf, "orders").select(
        "o_orderkey", F.rank().over(w).alias("r"), F.lag("o_totalprice").over(w).alias("before"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("three"), F.ntile(4).over(w).alias("quarter")
    )


@query(
    "session_windows",
    """WITH r AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM r)
    SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, run""",
    covers="src_sql session_window",
)
def session_windows(spark, sf):
    e = load(spark, sf, "events").groupBy("user_id", F.session_window("ts", "3 hours")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return e.select("user_id", "first_ts", "n")


@query(
    "upcoming",
    """SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 5 MINUTE ORDER BY ts, event_id LIMIT 1""",
    covers="x_upcoming",
)
def upcoming(spark, sf):
    return load(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-15 12:00:00' - INTERVAL 5 MINUTES").orderBy("ts", "event_id").limit(1).select("event_id", "ts")


@query(
    "now_indicator",
    """SELECT user_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15 12:00:00') AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15 12:00:00') AS after,
      bool_or(ts >= TIMESTAMP '2024-01-29') AS has_more_future FROM events GROUP BY 1""",
    covers="x_indicator x_tables_window",
)
def now_indicator(spark, sf):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return load(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("ts") < now).alias("before"), F.count_if(F.col("ts") >= now).alias("after"), F.bool_or(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")).alias("has_more_future"))


@query(
    "grouping_levels",
    "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())",
    covers="a_grouping_sets",
)
def grouping_levels(spark, sf):
    from pyspark.sql import functions as F

    sets = [["l_returnflag", "l_linestatus"], ["l_linenumber"], []]
    return load(spark, sf, "lineitem").groupingSets(sets, "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("approximate_counts", "SELECT o_orderstatus, TRUE AS near_users, TRUE AS near_median FROM orders GROUP BY 1", covers="a_approx_count_distinct a_approx_percentile")
def approximate_counts(spark, sf):
    """Approximate distinct counts and medians, held against the exact ones: within 10 % and 2 %.

    Distinct customers are pairs before they are counted; ranks beside the
    middle bound the prices among which the exact median lies, so a thousandth
    of a group is put in order and the rest is counted.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    orders = load(spark, sf, "orders").select(F.struct("o_orderstatus").alias("g"), "o_custkey", "o_totalprice")
    near = orders.groupBy("g").agg(
        F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.percentile_approx("o_totalprice", 0.5, 10000).alias("m"),
        F.percentile_approx("o_totalprice", [0.4995, 0.5005], 10000).alias("p"), F.count("o_totalprice").alias("n"),
    )
    exact = orders.where("o_custkey is not null").select("g", "o_custkey").distinct().groupBy("g").agg(F.count("*").alias("e"))
    # The rank error is a ten-thousandth of the group, so what lies between the two prices holds the middle ranks.
    bounds = F.broadcast(near.select("g", "n", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi")))
    priced = orders.join(bounds, "g")
    below = priced.where("o_totalprice < lo").groupBy("g").agg(F.count("*").alias("below"))
    between = priced.where("o_totalprice between lo and hi").groupBy("g", "n", "o_totalprice").agg(F.count("*").alias("k"))
    last = F.sum("k").over(Window.partitionBy("g").orderBy("o_totalprice"))
    ranked = between.withColumn("last", last).join(below, "g", "left").withColumn("last", F.col("last") + F.coalesce("below", F.lit(0)))
    at = lambda r: F.min(F.when(F.col("last") >= r, F.col("o_totalprice")))
    middle = ranked.groupBy("g").agg(((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2).alias("x"))
    o = near.join(exact, "g", "left").join(middle, "g", "left").select("g.o_orderstatus", "a", F.coalesce("e", F.lit(0)).alias("e"), "m", "x")
    return o.select("o_orderstatus", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("near_users"), (F.abs(F.col("m") - F.col("x")) <= 0.02 * F.col("x")).alias("near_median"))
