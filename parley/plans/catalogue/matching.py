"""Vectors, vocabulary and phonetic matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.text import cologne_code, word_tokens
from parley.operators import vectors as V
from parley.operators import vocabulary as O
from parley.operators.graph import checkpointed, components
from parley.plans.catalog import query
from parley.sources.tables import load

_CENTROIDS = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 1 + (SELECT max(len(e)) FROM v)) r(i) WHERE i <= len(e) GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY i) AS centroid FROM p GROUP BY 1),
"""


def _vectors(spark, sf):
    return load(spark, sf, "embeddings")


@query(
    "cosine_topk",
    _CENTROIDS + """s AS (SELECT vec_id, c.label, list_cosine_similarity(e, centroid) AS score FROM v, c)
    SELECT vec_id, label, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) <= 3""",
    covers="j_cosine sf_cosine",
)
def cosine_topk(spark, sf):
    """Exemplars are one centroid a label; each vector keeps its best three."""
    v = _vectors(spark, sf)
    best = V.best_of(v.select("vec_id", "embedding"), V.centroids(v, ["label"]), 3)
    return best.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    "mutual_best",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 1 + (SELECT max(len(e)) FROM v)) r(i) WHERE i <= len(e) AND vec_id % 2 = 0 GROUP BY 1, 2),
    c AS (SELECT label, list(x ORDER BY i) AS centroid FROM p GROUP BY 1),
    m AS (SELECT v.label AS speaker, c.label AS human, max(list_cosine_similarity(e, centroid)) AS score FROM v JOIN c ON v.label % 2 = c.label % 2 WHERE v.vec_id % 2 = 1 GROUP BY 1, 2),
    a AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY score DESC, human) AS n, lead(score) OVER (PARTITION BY speaker ORDER BY score DESC, human) AS second FROM m),
    b AS (SELECT *, row_number() OVER (PARTITION BY human ORDER BY score DESC, speaker) AS n, lead(score) OVER (PARTITION BY human ORDER BY score DESC, speaker) AS second FROM m)
    SELECT a.speaker, a.human, round(a.score, 6) AS score FROM a JOIN b ON a.speaker = b.speaker AND a.human = b.human
    WHERE a.n = 1 AND b.n = 1 AND a.score >= 0.62 AND (a.second IS NULL OR a.score - a.second >= 0.08) AND (b.second IS NULL OR b.score - b.second >= 0.08)""",
    covers="vp_match w_best_second",
)
def mutual_best(spark, sf):
    v = _vectors(spark, sf)
    samples = v.where("vec_id % 2 = 1").select(F.col("label").alias("speaker"), (F.col("label") % 2).alias("domain"), "embedding")
    exemplars = V.centroids(v.where("vec_id % 2 = 0"), ["label"]).select(F.col("label").alias("human"), (F.col("label") % 2).alias("domain"), F.col("centroid").alias("embedding"))
    return V.mutual_best(V.scores(samples, exemplars, ["domain"]), least=0.62, margin=0.08).select("speaker", "human", F.round("score", 6).alias("score"))


@query(
    "remote_candidates",
    "SELECT DISTINCT lower(c_name) AS address FROM customer WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM customer WHERE c_custkey IN (1, 2, 3)) AND c_nationkey = 4",
    covers="vp_remote",
)
def remote_candidates(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey", F.lower("c_name").alias("address"))
    own = c.where("c_custkey in (1, 2, 3)").select("address")
    return c.where("c_nationkey = 4").select("address").distinct().join(F.broadcast(own), "address", "left_anti")


_LINES = "SELECT CASE WHEN s_suppkey % 10 = 0 THEN upper(s_name) ELSE s_name END || ' => ' || s_nationkey || ' a;  ; ' || s_name || '; B ' || s_nationkey AS line FROM supplier"


@query(
    "dictionary_entries",
    f"""WITH l AS (SELECT trim(split_part(line, '=>', 1)) AS c, split_part(line, '=>', 2) AS rest FROM ({_LINES} UNION ALL SELECT 'Alone' UNION ALL SELECT s_name || ' => extra' FROM supplier WHERE s_suppkey < 5)),
    a AS (SELECT c, lower(trim(unnest(string_split(rest, ';')))) AS alias FROM l),
    k AS (SELECT lower(c) AS key, min(c) AS canonical FROM l GROUP BY 1)
    SELECT canonical, alias FROM k LEFT JOIN (SELECT DISTINCT lower(c) AS key, alias FROM a WHERE alias <> '' AND alias <> lower(c)) x USING (key)""",
    covers="v_parse",
)
def dictionary_entries(spark, sf):
    s = load(spark, sf, "supplier")
    name = F.when(F.col("s_suppkey") % 10 == 0, F.upper("s_name")).otherwise(F.col("s_name"))
    nation = F.col("s_nationkey").cast("string")
    lines = s.select(F.concat(name, F.lit(" => "), nation, F.lit(" a;  ; "), F.col("s_name"), F.lit("; B "), nation).alias("line"))
    lines = lines.unionByName(spark.createDataFrame([("Alone",)], "line string")).unionByName(s.where("s_suppkey < 5").select(F.concat("s_name", F.lit(" => extra")).alias("line")))
    return O.entries(lines)


@query("risky_aliases", "SELECT DISTINCT p_name AS alias FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size = 7)", covers="v_risky")
def risky_aliases(spark, sf):
    p = load(spark, sf, "part")
    return O.risky(p.select(F.lower("p_name").alias("alias")).distinct(), p.where("p_size = 7").select(F.col("p_name").alias("phrase")).distinct()).select("alias")


def _aliases(spark):
    return spark.createDataFrame([("Theatre", "the"), ("Ofonly", "of only"), ("Andbig", "and"), ("Andsmall", "and"), ("Idiot", "moron")], "canonical string, alias string")


@query("corrections", None, covers="v_apply")
def corrections(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return O.corrected(docs, _aliases(spark)).select("id", "n", F.sha2("text", 256).alias("digest"))


@query(
    "correction_counts",
    """SELECT id, count(*) AS n FROM (SELECT doc_id AS id, unnest(string_split_regex(trim(text), '\\s+')) AS w FROM documents) WHERE lower(regexp_extract(w, '^[^\\p{L}\\p{N}]*(.*?)[^\\p{L}\\p{N}]*$', 1)) IN ('the', 'moron') GROUP BY 1""",
    covers="v_apply",
)
def correction_counts(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    pairs = spark.createDataFrame([("Theatre", "the"), ("Idiot", "moron")], "canonical string, alias string")
    return O.replacements(docs, pairs).groupBy("id").agg(F.count("*").alias("n"))


_SPLIT = r"""WITH t AS (SELECT conv_id, turn, role, string_split_regex(trim(text), '[ \t\n\r\f]+') AS w FROM conversations WHERE trim(text) <> ''),
    p AS (SELECT conv_id, role, turn::BIGINT * 900000 + (unnest(range(1, len(w) + 1)) - 1) * 300 AS s, unnest(w) AS x FROM t),
    c AS (SELECT *, lower(regexp_extract(x, '^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}]*$', 1)) AS core, regexp_extract(x, '^([^\p{L}\p{N}]*)', 1) AS pre, regexp_extract(x, '([^\p{L}\p{N}]*)$', 1) AS suf FROM p),
    n AS (SELECT *, CASE core WHEN 'the' THEN [pre || 'Theatre' || suf] WHEN 'that' THEN [pre || 'Great', 'Hat' || suf] ELSE [x] END AS y FROM c),
    e AS (SELECT *, CASE WHEN len(y) = 2 THEN s + round(250.0 * length(y[1]) / (length(y[1]) + length(y[2])))::BIGINT END AS cut FROM n)
    SELECT conv_id, role, s AS start_ms, coalesce(cut, s + 250) AS end_ms, y[1] AS text FROM e UNION ALL SELECT conv_id, role, cut, s + 250, y[2] FROM e WHERE len(y) = 2"""


@query("timed_corrections", _SPLIT, covers="v_rewrite_words v_apply")
def timed_corrections(spark, sf):
    """Turns as words of 250 ms every 300 ms, with one alias for a word and one for two."""
    c = load(spark, sf, "conversations").where(F.trim("text") != "").select("conv_id", "turn", "role", F.posexplode(F.split(F.trim("text"), r"[ \t\n\r\f]+")).alias("i", "text"))
    start = F.col("turn").cast("long") * 900_000 + F.col("i") * 300
    words = c.select(F.col("conv_id").alias("id"), F.lit(0).alias("channel"), F.col("role").alias("speaker"), start.alias("start_ms"), (start + 250).alias("end_ms"), "text", F.lit(None).cast("double").alias("confidence"))
    out = O.rewritten_words(words, spark.createDataFrame([("Theatre", "the"), ("Great Hat", "that")], "canonical string, alias string"))
    return out.select(F.col("id").alias("conv_id"), F.col("speaker").alias("role"), "start_ms", "end_ms", "text")


def _names(spark, sf, ordinary):
    """Names that people wrote beside the documents: the capitalised words of four letters or more of the benchmark's texts that are not ordinary."""
    words = load(spark, sf, "benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word"))
    return words.where((F.length("word") >= 4) & F.col("word").rlike(r"^\p{Lu}")).join(ordinary.select(F.col("word").alias("common")), F.lower("word") == F.col("common"), "left_anti").distinct()


def _ordinary(docs):
    """Ordinary words of the documents themselves, met by candidates and compounds alike."""
    return checkpointed(O.ordinary_words(docs))


def _candidates(docs, ordinary):
    """Candidates, few beside the documents' words, which are thereby read once for all that they meet."""
    return checkpointed(O.candidates(docs, ordinary))


def _decided(spark):
    """Pairs that the dictionary knows, and pairs that were dismissed."""
    return spark.createDataFrame([("License", "Licence")], "canonical string, alias string"), spark.createDataFrame([("Public", "Publik")], "canonical string, alias string")


@query("name_proposals", None, covers="v_candidates v_recurrence a_recurrence o_proposals sf_is_inflection j_fuzzy_block sf_koelner")
def name_proposals(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    ordinary = _ordinary(docs)
    return O.undecided(O.proposals(_candidates(docs, ordinary), _names(spark, sf, ordinary), ordinary=ordinary), *_decided(spark)).orderBy(F.col("occurrences").desc(), F.col("sessions").desc(), "canonical", "alias")


#: The phonetic code of Cologne of words of ASCII letters, by rules on each letter and its neighbours.
_CODES = r"""t AS (SELECT p_name AS text FROM part UNION ALL SELECT text FROM benchmark),
    w AS (SELECT DISTINCT unnest(list_filter(string_split_regex(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND strlen(x) <= 40)) AS word FROM t),
    l AS (SELECT word, string_split(regexp_replace(upper(word), '[^A-Z]', '', 'g'), '') AS s FROM w WHERE regexp_matches(word, '[a-z]')),
    d AS (SELECT word, array_to_string(list_transform(s, lambda c, i: CASE
        WHEN c IN ('A', 'E', 'I', 'J', 'O', 'U', 'Y') THEN '0' WHEN c = 'B' THEN '1' WHEN c IN ('F', 'V', 'W') THEN '3' WHEN c IN ('G', 'K', 'Q') THEN '4' WHEN c = 'L' THEN '5' WHEN c IN ('M', 'N') THEN '6' WHEN c = 'R' THEN '7' WHEN c IN ('S', 'Z') THEN '8'
        WHEN c = 'P' THEN CASE WHEN s[i + 1] = 'H' THEN '3' ELSE '1' END WHEN c IN ('D', 'T') THEN CASE WHEN s[i + 1] IN ('C', 'S', 'Z') THEN '8' ELSE '2' END
        WHEN c = 'X' THEN CASE WHEN i > 1 AND s[i - 1] IN ('C', 'K', 'Q') THEN '8' ELSE '48' END
        WHEN c = 'C' AND i = 1 THEN CASE WHEN s[2] IN ('A', 'H', 'K', 'L', 'O', 'Q', 'R', 'U', 'X') THEN '4' ELSE '8' END
        WHEN c = 'C' THEN CASE WHEN s[i - 1] NOT IN ('S', 'Z') AND s[i + 1] IN ('A', 'H', 'K', 'O', 'Q', 'U', 'X') THEN '4' ELSE '8' END ELSE '' END), '') AS raw FROM l),
    e AS (SELECT word, string_split(raw, '') AS s FROM d WHERE raw <> ''),
    f AS (SELECT word, list_filter(s, lambda c, i: i = 1 OR c <> s[i - 1]) AS s FROM e),
    k AS MATERIALIZED (SELECT word, array_to_string(list_filter(s, lambda c, i: i = 1 OR c <> '0'), '') AS code FROM f)"""


@query(
    "phonetic_block",
    f"""WITH {_CODES} SELECT a.word AS a, b.word AS b FROM k a JOIN k b ON a.code[1] = b.code[1] AND a.word < b.word
    WHERE length(a.code) >= 3 AND length(b.code) >= 3 AND levenshtein(a.code, b.code) <= 1 AND levenshtein(a.word, b.word) * 5 <= greatest(length(a.word), length(b.word)) * 2""",
    covers="j_fuzzy_block sf_koelner",
)
def phonetic_block(spark, sf):
    """Words of part names and of benchmark texts, written in ASCII, that sound alike."""
    texts = load(spark, sf, "part").select(F.col("p_name").alias("text")).unionByName(load(spark, sf, "benchmark").select("text"))
    words = texts.select(F.explode(word_tokens("text")).alias("word")).distinct().withColumn("code", cologne_code("word")).where(F.length("code") >= 3)
    return O.alike(words, F.substring("code", 1, 1))


@query(
    "fuzzy_components",
    """WITH RECURSIVE n AS (SELECT DISTINCT p_name AS w FROM part), e AS (SELECT a.w AS x, b.w AS y FROM n a JOIN n b ON a.w <> b.w AND levenshtein(a.w, b.w) <= 3),
    r(w, t) AS (SELECT w, w FROM n UNION SELECT r.w, e.y FROM r JOIN e ON e.x = r.t) SELECT w AS name, min(t) AS component FROM r WHERE w IN (SELECT x FROM e) GROUP BY 1""",
    covers="v_recurrence",
)
def fuzzy_components(spark, sf):
    """Names are nodes by hash; names within three edits differ by three letters at most, so blocks of four lengths and the next one bring all pairs together."""
    names = load(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().withColumn("id", F.xxhash64("name"))
    first = (F.length("name") / 4).cast("int")
    n = names.withColumn("block", F.explode(F.sequence(first, first + 1)))
    b = n.select(F.col("id").alias("b"), F.col("name").alias("other"), "block")
    edges = n.join(b, "block").where((F.col("id") < F.col("b")) & (F.levenshtein("name", "other") <= 3)).select(F.col("id").alias("a"), "b").distinct()
    named = components(edges).join(names, "id")
    least = named.groupBy("component").agg(F.min("name").alias("least"))
    return named.join(least, "component").select("name", F.col("least").alias("component"))


@query("context_proposals", None, covers="v_context")
def context_proposals(spark, sf):
    """Candidates beside the names of their context; documents have no measured confidence, and the names belong to all of them."""
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    ordinary = _ordinary(docs)
    found = _candidates(docs, ordinary).withColumn("confidence", F.lit(None).cast("double"))
    return O.context_proposals(found, _everywhere(spark, sf, ordinary), ordinary=ordinary)


def _everywhere(spark, sf, ordinary):
    return _names(spark, sf, ordinary).select(F.lit(None).cast("long").alias("id"), "word", F.lit(2).alias("rank"))


@query("vocabulary_scan", None, covers="v_scan v_recurrence v_context o_proposals")
def vocabulary_scan(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    ordinary = _ordinary(docs)
    found = _candidates(docs, ordinary).withColumn("confidence", F.lit(None).cast("double"))
    out = O.scan(found, _names(spark, sf, ordinary), _everywhere(spark, sf, ordinary), *_decided(spark), ordinary=ordinary)
    return out.orderBy(F.col("occurrences").desc(), F.col("sessions").desc(), "canonical", "alias")
