"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from parley.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = shipped
    return shipped


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.minhash_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=2, percent=80)


ORACLE_SQL["op3_minhash_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
d AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, d.y FROM r JOIN d ON d.x = r.to_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.to_id) AS component_id, n.doc_id = min(r.to_id) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""


def _remainder(n: int):
    from pyspark.sql import functions as F

    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from parley.llm.langid import fit, predict

    docs = _read(spark, sf_dir, "documents")
    rest = F.coalesce(_remainder(3), F.lit(0))
    scored = predict(docs, fit(docs, rest != 1))
    return scored.select("doc_id", (rest == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from parley.llm.substring_dedup import remove_repeats

    done = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), size=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL["op4_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
g AS (SELECT doc_id, i AS pos, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
m AS (
  SELECT p.doc_id, p.pos, p.word, max(r.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS UNBOUNDED PRECEDING) AS last
  FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.pos = p.pos),
k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE last + 34 >= pos) AS n_removed,
    string_agg(word, ' ' ORDER BY pos) FILTER (WHERE last IS NULL OR last + 34 < pos) AS kept FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


@_query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from parley.llm.decontaminate import contamination

    found = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL["op5_decontaminate"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s:s + 9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
l AS (SELECT DISTINCT n FROM i),
d AS (
  SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, l)),
h AS (SELECT DISTINCT doc_id, s, d.n, item_id FROM d JOIN i ON i.g = d.g AND i.n = d.n),
p AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS pos FROM h),
c AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@_query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.mixing import mix

    done = mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(1, 2, 3))
    return done.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def token_summary(docs: DataFrame) -> DataFrame:
    """Writes the files of documents in the shared folder and sums them up as they read back."""
    import public_tokenizers

    from parley.llm._shared import Scratch, checkpointed
    from parley.llm.tokenids import summarise_corpus, write_corpus

    with Scratch(docs.sparkSession, "corpus") as files:
        write_corpus(docs, files.path, public_tokenizers.path("word_bpe_49k.json"), end=2)
        return checkpointed(summarise_corpus(docs.sparkSession, files.path))


@_query
def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_summary(_read(spark, sf_dir, "documents"))


@_query
def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.vector_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.93)


ORACLE_SQL["op10_vector_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
d AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT x, count(*) AS n FROM d GROUP BY 1),
r(vec_id, to_id) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, d.y FROM r JOIN d ON d.x = r.to_id)
SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(to_id) AS component_id, r.vec_id = min(to_id) AS kept
FROM r LEFT JOIN n ON n.x = r.vec_id GROUP BY r.vec_id
"""


@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from parley.llm.quality import fit, predict

    docs = _read(spark, sf_dir, "documents")
    rest = F.coalesce(_remainder(5), F.lit(1))
    scored = predict(docs, fit(docs, _read(spark, sf_dir, "labels"), rest != 0))
    return scored.select("doc_id", (rest == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from parley.llm.toxicity import fit, predict

    docs = _read(spark, sf_dir, "documents")
    rest = F.coalesce(_remainder(3), F.lit(0))
    scored = predict(docs, fit(docs, _read(spark, sf_dir, "labels"), rest != 1))
    return scored.select("doc_id", (rest == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: A conversation whose texts hold control strings.
HOSTILE = '{"id": -7, "messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


@_query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from parley.llm.chat import canonical, canonical_table, formatted, read_back

    hostile = canonical(spark.createDataFrame([(HOSTILE,)], "record string"))
    turns = canonical_table(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).unionByName(hostile)
    told = read_back(formatted(turns)).select("conv_id", F.struct("turn", "part", "role", "text", "loss_text").alias("t"), "piece_chars")
    whole = told.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"), F.count("*").alias("n_turns"), F.sum("piece_chars").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("t", lambda x: x["loss_text"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op8_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
e AS (
  SELECT *, length(replace(role, '\', '\\')) + length(replace(text, '\', '\\')) AS chars,
    len(regexp_extract_all(role || ' ' || text, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|<\|end\|>|<s>|</s>|<bos>|<eos>|<pad>|<unk>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<start_of_turn>|<end_of_turn>')) AS marks
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars + marks + 33)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@_query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.divergence import audit

    return audit(_read(spark, sf_dir, "documents"))


ORACLE_SQL["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS MATERIALIZED (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS MATERIALIZED (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.n + 2 * v.v))::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v))::BIGINT AS q
  FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
y AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM y
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM z) WHERE rank <= 10
"""


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Sequences (conv_id, ids, sizes) with their first h turns taken from the conversation that begins their group of five; h is a hash of the id, 0 to 8."""
    from pyspark.sql import functions as F

    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    base = sequences.select(F.col("conv_id").alias("base"), F.slice("ids", 1, 8).alias("base_ids"), F.slice("sizes", 1, 8).alias("base_sizes"))
    both = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", h).join(base, "base", "left")

    def put(own: str, other: str):
        return F.concat(F.slice(F.coalesce(other, F.array().cast("array<long>")), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.size(own) + 1)).alias(own)

    return both.select("conv_id", put("ids", "base_ids"), put("sizes", "base_sizes"))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm._shared import checkpointed
    from parley.llm.prefix_trie import encoded, trie

    return trie(checkpointed(rebuilt(encoded(_read(spark, sf_dir, "conversations")))))


ORACLE_SQL["op12_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, turn, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS m FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT conv_id, list(m ORDER BY turn NULLS FIRST, sha256(length(m.r)::VARCHAR || ':' || m.r || m.t)) AS ms FROM t GROUP BY 1),
c AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(0, 8), lambda i: 0::UBIGINT)), lambda s, u: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) AS v
  FROM o),
h AS (SELECT conv_id, xor(v, 4294967295::UBIGINT)::BIGINT % 9 AS h FROM c),
b AS MATERIALIZED (
  SELECT o.conv_id, list_concat(coalesce(p.ms, [])[1:h.h], o.ms[h.h + 1:]) AS ms
  FROM o JOIN h USING (conv_id) LEFT JOIN o p ON p.conv_id = o.conv_id - o.conv_id % 5),
e AS (SELECT conv_id, ms, unnest(range(0, len(ms) + 1)) AS d FROM b),
f AS MATERIALIZED (SELECT conv_id, d, md5(d::VARCHAR || ms[1:d]::VARCHAR) AS k, CASE WHEN d > 0 THEN md5((d - 1)::VARCHAR || ms[1:d - 1]::VARCHAR) END AS pk, d = len(ms) AS ends, CASE WHEN d > 0 THEN octet_length(encode(ms[d].t)) ELSE 0 END AS size FROM e),
n AS MATERIALIZED (
  SELECT k, any_value(pk) AS pk, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM f GROUP BY k),
m AS (SELECT pk AS k, count(*) AS n_children FROM n WHERE pk IS NOT NULL GROUP BY 1),
s AS (
  SELECT f.k, sum(n.own) AS saved_tokens, count(*) FILTER (WHERE m.k IS NULL) AS n_leaves
  FROM n LEFT JOIN m USING (k) JOIN f ON f.conv_id = n.conv_id AND f.d <= n.depth GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(m.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n p ON p.k = n.pk LEFT JOIN m ON m.k = n.k JOIN s ON s.k = n.k
"""


#: Rules of hosts and paths, and what they say.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@_query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.url_filter import fit, judge, rule_labels

    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, URL_RULES, fit(rule_labels(pages, URL_RULES))).select("page_id", "host", "path", "rule", "verdict", "blocked")
