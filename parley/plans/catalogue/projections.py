"""Projections, plain joins and small scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import search as S
from parley.plans.catalog import query
from parley.sources.tables import load
from parley.streaming import live_words as L


@query("canonical_first", "SELECT c_custkey, c_name FROM customer ORDER BY CASE WHEN c_custkey = 77 THEN 0 ELSE 1 END, c_name DESC, c_custkey LIMIT 10", covers="p_case_rank")
def canonical_first(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_name")
    return c.orderBy(F.when(F.col("c_custkey") == 77, 0).otherwise(1), F.col("c_name").desc(), "c_custkey").limit(10)


@query("rows_as_json", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS j FROM nation""", covers="p_row_to_json src_sql")
def rows_as_json(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("j"))


@query("freshest", "SELECT o_orderkey, greatest(o_orderdate, coalesce(max(l_shipdate), o_orderdate)) AS freshest FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate", covers="p_greatest human_sessions")
def freshest(spark, sf):
    """Lines are reduced to one row an order before the join."""
    li = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("s"))
    return load(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(li, "o_orderkey", "left").select("o_orderkey", F.greatest("o_orderdate", "s").alias("freshest"))


@query("active_children", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' AND l_quantity > 45", covers="j_inner_eq f_active")
def active_children(spark, sf):
    o = load(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return load(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")


@query(
    "composite_keys",
    "SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE a.l_linenumber < 3 GROUP BY 1, 2, 3",
    covers="j_multi_key",
)
def composite_keys(spark, sf):
    k = ["l_orderkey", "l_partkey", "l_suppkey"]
    li = load(spark, sf, "lineitem")
    b = li.groupBy(*k).agg(F.count("*").alias("m"))
    a = li.where("l_linenumber < 3").groupBy(*k).agg(F.count("*").alias("c"))
    return a.join(b, k).select(*k, (F.col("c") * F.col("m")).alias("n"))


@query("orders_of_segment", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", covers="j_semi_in")
def orders_of_segment(spark, sf):
    c = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query(
    "overlapping_range",
    "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-05 06:00:00' AND CASE WHEN event_type = 'view' THEN ts ELSE ts + INTERVAL 90 MINUTE END >= TIMESTAMP '2024-01-05'",
    covers="j_interval_overlap",
)
def overlapping_range(spark, sf):
    """Events that overlap a range; one without an end lasts no time. The range of starts reaches the scan."""
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    end = F.when(F.col("event_type") == "view", F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 90 MINUTES"))
    return load(spark, sf, "events").where((F.col("ts") <= stamp("2024-01-05 06:00:00")) & (F.col("ts") >= stamp("2024-01-04 22:30:00")) & (end >= stamp("2024-01-05"))).select("event_id")


@query("plain_strings", "SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS name, instr(p_name, ' ') AS at, replace(p_brand, '#', '') AS brand, length(p_type) AS n, nullif(p_type, 'ECONOMY') AS kind, ltrim(p_brand, 'Bra') AS tail FROM part", covers="sf_lower sf_nullif")
def plain_strings(spark, sf):
    p = load(spark, sf, "part")
    return p.select(
        "p_partkey", F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.substring(F.col("p_name"), F.lit(2), F.length("p_name")))).alias("name"), F.instr("p_name", " ").alias("at"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"),
        F.length("p_type").alias("n"), F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("kind"), F.ltrim(F.col("p_brand"), F.lit("Bra")).alias("tail"),
    )


def _count(words) -> str:
    return f"len(list_filter(w, lambda x: x IN {tuple(words)}))"


@query(
    "frequent_word_language",
    f"""WITH d AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND strlen(x) <= 40) AS w FROM documents),
    c AS (SELECT doc_id, lang, unnest([{", ".join(f"{{'code': '{c}', 'n': {_count(T.FREQUENT[c])}}}" for c in sorted(T.FREQUENT))}]) AS c FROM d),
    g AS (SELECT doc_id, any_value(lang) AS lang, max(c.n) AS n, min_by(c.code, {{'n': -c.n, 'code': c.code}}) AS code FROM c GROUP BY 1)
    SELECT doc_id, CASE WHEN n > 0 THEN code END AS guess, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang END AS lang FROM g""",
    covers="sf_lang_detect sf_lang_parse",
)
def frequent_word_language(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", T.frequent_word_language("text").alias("guess"), T.language_code("lang").alias("lang"))


@query(
    "query_parts",
    r"""WITH b AS (SELECT doc_id AS id, ' ' || array_to_string(list_filter(string_split_regex(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^\p{L}\p{N}]+'), lambda w: w <> '' AND strlen(w) <= 40), ' ') || ' ' AS body FROM documents)
    SELECT id FROM b WHERE instr(body, ' the ') > 0 AND NOT instr(body, ' license ') > 0 AND (instr(body, ' of the ') > 0 OR instr(body, ' und ') > 0)""",
    covers="sf_query_parts fts_parse",
)
def query_parts(spark, sf):
    """Documents that a parsed query admits: all '+' parts, no '-' part, and any of the others where there are some."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    body = F.concat(F.lit(" "), F.array_join(T.word_tokens("content"), " "), F.lit(" "))
    has = lambda terms: F.instr(body, f" {' '.join(terms)} ") > 0
    keep, other = F.lit(True), None
    for sign, terms in S.parse('+the -license "of the" und'):
        if sign == "+":
            keep &= has(terms)
        elif sign == "-":
            keep &= ~has(terms)
        else:
            other = has(terms) if other is None else other | has(terms)
    return d.where(keep & (other if other is not None else F.lit(True))).select("id")


@query("overlap_trimmed", None, covers="s_overlap_trim s_accumulate")
def overlap_trimmed(spark, sf):
    """Turns that repeat the end of the turn before lose the repetition; the words of one turn are a bounded list."""
    from pyspark.sql import Window
    from pyspark.sql.types import IntegerType

    @F.pandas_udf(IntegerType())
    def kept(before, words):
        return words.combine(before, lambda w, b: len(L.collapsed(L.overlap_trimmed(list(b if b is not None else []), list(w)))))

    c = load(spark, sf, "conversations").select("conv_id", "turn", F.split(F.trim("text"), r"\s+").alias("w"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("before", F.coalesce(F.lag("w").over(w), F.array().cast("array<string>")))
    said = F.concat(F.slice("before", -3, 3), F.col("w"))
    return c.select("conv_id", "turn", F.size("w").alias("words"), kept("before", F.when(F.size("before") >= 3, said).otherwise(F.col("w"))).alias("kept"))
