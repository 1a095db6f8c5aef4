"""Full-text queries over documents: source and language as title and facet, text as content."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.functions.text import ngrams
from parley.operators import search as S
from parley.operators.graph import shared_folder
from parley.operators.kept_index import KeptIndex, kept
from parley.plans.catalog import query
from parley.sources.tables import load, spread

_FOLD = "replace(strip_accents(lower({})), 'ß', 'ss')"
_TOKENS = r"list_filter(string_split_regex(replace(strip_accents(lower({})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND strlen(w) <= 40)"
_BASE = f"""WITH d AS (SELECT doc_id AS id, {_TOKENS.format("text")} AS w, {_TOKENS.format("concat(lang, ' ', source)")} AS tw, lang, source, n_chars, text FROM documents),
c AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean, avg(len(tw)) AS tmean FROM d),"""
_HITS = """h AS (SELECT id, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS length FROM d, (VALUES {}) v(term) WHERE list_contains(w, term)),
f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
s AS (SELECT id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS score FROM h JOIN f USING (term), c)"""


def _docs(spark, sf):
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "lang", "source").alias("title"), F.col("text").alias("content"), "lang", "source", "n_chars")


def _index(spark, sf) -> KeptIndex:
    """The kept index of documents; the first search of a table's files builds it, later ones and later sessions open it."""
    return kept(spark, f"{shared_folder(spark)}/search", _docs(spark, sf).select("id", "title", "content"))


@query("bm25_topk", f"{_BASE} {_HITS.format(chr(39).join(['(', 'idiot', '), (', 'license', '), (', 'nicht', ')']))} SELECT id, round(sum(score), 6) AS score, count(*) OVER () AS total FROM s GROUP BY 1 ORDER BY score DESC, id LIMIT 20", covers="fts_index fts_df fts_idf fts_bm25 fts_parse fts_topk fts_count o_topk_score a_fts_count")
def bm25_topk(spark, sf):
    terms = [t for _, part in S.parse("idiot license nicht") for t in part]
    return S.top(_index(spark, sf).any_of(terms, {"content": 1.0}).withColumn("score", F.round("score", 6)), 20)


@query(
    "bool_must",
    f"""{_BASE} t(term) AS (VALUES ('en'), ('license')),
    hc AS (SELECT id, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS length FROM d, t WHERE list_contains(w, term)),
    ht AS (SELECT id, term, len(list_filter(tw, lambda x: x = term)) AS tf, len(tw) AS length FROM d, t WHERE list_contains(tw, term)),
    s AS (SELECT id, hc.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS score FROM hc JOIN (SELECT term, count(*) AS df FROM hc GROUP BY 1) USING (term), c
      UNION ALL SELECT id, ht.term, 3.0 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / tmean)) FROM ht JOIN (SELECT term, count(*) AS df FROM ht GROUP BY 1) USING (term), c)
    SELECT id, round(sum(score), 6) AS score FROM s GROUP BY 1 HAVING count(DISTINCT term) = 2""",
    covers="fts_bool_must",
)
def bool_must(spark, sf):
    return _index(spark, sf).all_of(["en", "license"], {"title": S.TITLE_BOOST, "content": 1.0}).select("id", F.round("score", 6).alias("score"))


@query("phrase", f"{_BASE} x AS (SELECT 1) SELECT id FROM d WHERE instr(' ' || array_to_string(w, ' ') || ' ', ' under the mit ') > 0", covers="fts_phrase")
def phrase(spark, sf):
    return _index(spark, sf).phrase(["under", "the", "mit"], "content")


@query("phrase_slop", f"{_BASE} x AS (SELECT 1) SELECT id FROM d WHERE regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' (released the|released [^ ]+ the|released [^ ]+ [^ ]+ the) ')", covers="fts_slop")
def phrase_slop(spark, sf):
    return _index(spark, sf).phrase(["released", "the"], "content", slop=2)


@query("search_filters", f"{_BASE} {_HITS.format(chr(39).join(['(', 'the', ')']))} SELECT id, round(score, 6) AS score FROM s JOIN d USING (id) WHERE lang = 'en' AND starts_with(source, 'src1') AND n_chars BETWEEN 500 AND 2000", covers="fts_filters")
def search_filters(spark, sf):
    """Filters reach the scan; the score still counts all documents."""
    some = _docs(spark, sf).where("lang = 'en' and source like 'src1%' and n_chars between 500 and 2000").select("id")
    return _index(spark, sf).any_of(["the"], {"content": 1.0}).join(some, "id", "left_semi").select("id", F.round("score", 6).alias("score"))


@query("match_all", "SELECT doc_id AS id, 1.0 AS score FROM documents ORDER BY id LIMIT 100", covers="fts_all")
def match_all(spark, sf):
    return _docs(spark, sf).select("id", F.lit(1.0).alias("score")).orderBy("id").limit(100)


@query("fuzzy_terms", f"{_BASE} t AS (SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(w)) AS term FROM d) WHERE length(term) BETWEEN 4 AND 6 GROUP BY 1) SELECT term, df FROM t WHERE damerau_levenshtein(term, 'idito') <= 1", covers="fts_fuzzy sf_levenshtein")
def fuzzy_terms(spark, sf):
    return S.fuzzy_terms(_docs(spark, sf), "content", "idito")


@query(
    "ngram_terms",
    f"""WITH p AS (SELECT {_FOLD.format("p_name")} AS t FROM part UNION ALL SELECT {_FOLD.format("text")} FROM benchmark), d AS (SELECT t, count(*) AS k FROM p GROUP BY 1),
    i AS (SELECT t, k, unnest(range(1, length(t) + 1)) AS i FROM d), g AS (SELECT substr(t, i, n) AS gram, k FROM i, range(1, 4) b(n) WHERE i + n - 1 <= length(t))
    SELECT gram, sum(k)::BIGINT AS n FROM g GROUP BY 1""",
    covers="sf_tokenize_ngram",
)
def ngram_terms(spark, sf):
    """Terms of part names, and of benchmark texts, which have accents."""
    texts = load(spark, sf, "part").select(F.col("p_name").alias("text")).unionByName(load(spark, sf, "benchmark").select("text"))
    return texts.select(F.explode(ngrams("text")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("index_postings", f"{_BASE} t AS (SELECT id, unnest(w) AS term FROM d) SELECT term, count(*) AS cf, count(DISTINCT id) AS df FROM t GROUP BY 1 HAVING df > 20", covers="fts_index")
def index_postings(spark, sf):
    p = _index(spark, sf).postings().where("field = 'content'")
    return p.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).where("df > 20")


@query(
    "index_replaced",
    f"""{_BASE} e AS (SELECT id, CASE WHEN id % 10 = 1 THEN ['fresh', 'words', 'fresh'] ELSE w END AS w FROM d WHERE id % 10 <> 2)
    SELECT id, count(*) AS terms, sum(tf)::BIGINT AS words FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM e) GROUP BY 1, 2) GROUP BY 1""",
    covers="sink_index fts_incremental",
)
def index_replaced(spark, sf):
    """Two batches on a copy of the index: changed documents, then removed ones; the second opens it anew, as after a restart."""
    d = _docs(spark, sf).select("id", "content")
    with_path = f"{shared_folder(spark)}/replaced-{uuid.uuid4().hex}"
    KeptIndex(spark, with_path).build(d, ["content"])
    KeptIndex(spark, with_path).update(d.where("id % 10 = 1").select("id", F.lit("Fresh words, fresh!").alias("content")), d.where("false").select("id"), 0)
    KeptIndex(spark, with_path).update(d.where("false"), d.where("id % 10 = 2").select("id"), 1)
    return KeptIndex(spark, with_path).postings().groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("words"))


@query(
    "snippets",
    rf"""{_BASE} o AS (SELECT doc_id AS id, list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND strlen(replace(strip_accents(lower(x)), 'ß', 'ss')) <= 40) AS words FROM documents),
    p AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d),
    f AS (SELECT term, count(DISTINCT id) AS df FROM p WHERE term IN ('license', 'under', 'mit') GROUP BY 1),
    h AS (SELECT id, pos, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS weight FROM p JOIN f USING (term), c),
    s AS (SELECT id, pos, round(sum(weight) OVER v, 6) AS weight, list(pos) OVER v AS places FROM h WINDOW v AS (PARTITION BY id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 23 FOLLOWING)),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, pos) = 1)
    SELECT b.id, array_to_string(words[greatest(pos - 3, 0) + 1:greatest(pos - 3, 0) + 27], ' ') AS fragment, weight, list_aggregate(list_transform(places, lambda x: x - greatest(pos - 3, 0)), 'string_agg', ',') AS hits FROM b JOIN o USING (id)""",
    covers="fts_snippet sf_snippet",
)
def snippets(spark, sf):
    """The 24 words of each document in which its terms weigh most, with the places of the terms."""
    docs = _docs(spark, sf).select("id", "content")
    return _index(spark, sf).snippets(["license", "under", "mit"], "content", docs).select("id", "fragment", "weight", F.array_join(F.col("hits").cast("array<string>"), ",").alias("hits"))


_STOP = ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "die", "der", "und", "le", "la", "de", "et", "el", "que", "y")
_CORE = r"regexp_extract({}, '^[^\p{{L}}\p{{N}}]*(.*?)[^\p{{L}}\p{{N}}]*$', 1)"


@query(
    "keywords",
    rf"""WITH c AS (SELECT doc_id AS id, source, regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g') AS body FROM documents),
    w AS (SELECT id, list_filter(string_split_regex(translate(body, '#*_~`[]()', '         '), '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM c),
    t AS (SELECT id, unnest(range(1, len(w) + 1)) AS i, w FROM w),
    k AS (SELECT id, i, w[i] AS word, {_CORE.format("w[i]")} AS core, i = 1 OR regexp_matches(w[i - 1], '[.!?][^\p{{L}}\p{{N}}]*$') AS starts, regexp_matches(w[i], '[.!?][^\p{{L}}\p{{N}}]*$') AS ends FROM t),
    m AS (SELECT *, length(core) >= 2 AND regexp_matches(core, '\p{{L}}') AND (lower(core) NOT IN {_STOP} OR (regexp_matches(core, '^\p{{Lu}}') AND NOT starts)) AS good FROM k),
    p AS (SELECT id, trim(unnest(string_split(string_agg(CASE WHEN starts THEN chr(10) ELSE '' END || CASE WHEN good THEN core ELSE chr(10) END, ' ' ORDER BY i), chr(10)))) AS term FROM m GROUP BY 1),
    f AS (SELECT id, 1 AS rank, i, term FROM (SELECT id, generate_subscripts(h, 1) AS i, unnest(h) AS term FROM (SELECT id, regexp_extract_all(body, '#([\p{{L}}\p{{N}}_]+)', 1) AS h FROM c))
      UNION ALL SELECT id, 0, 1, source FROM c UNION ALL SELECT id, 2, i, core FROM m WHERE good UNION ALL SELECT id, 3, 0, term FROM p WHERE instr(term, ' ') > 0),
    g AS (SELECT id, lower(term) AS key, min(rank * 1000000000000 + i) AS first, count(*) FILTER (rank = 2) AS n2, count(*) FILTER (rank = 3) AS n3 FROM f WHERE length(term) >= 2 GROUP BY 1, 2),
    s AS (SELECT id, key, first, CASE first // 1000000000000 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE 0 END AS n FROM g)
    SELECT id, key AS term, n, row_number() OVER (PARTITION BY id ORDER BY first // 1000000000000, n DESC, first, key) AS place FROM s QUALIFY place <= 50""",
    covers="sf_stopword sf_keywords x_keyword_filter",
)
def keywords(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.array("source").alias("named"))
    return S.keywords(spread(d), _STOP).select("id", F.lower("term").alias("term"), "n", "place")
