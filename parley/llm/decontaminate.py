"""Benchmark decontamination by a hash set of normalised test n-grams, in DataFrame operations only.

A benchmark item's windows are its runs of `size` words; an item of fewer words
is one window. Every window is looked up by one of its words, its anchor: the
longest, which in running text is rarest. Training words meet the anchors in a
hash join, each meeting proposes the window's start in its document, and the
words there are compared with the window's own. The anchors and windows are
broadcast only where their number is within BROADCAST_WINDOWS; beyond it the
same joins shuffle.

Words are runs of ASCII letters and digits and of everything beyond ASCII,
with A-Z lower-cased. Whole documents go (`keep_clean`), or the hit words alone
(`without_spans`). Defined results: null texts and items have no words; repeated
rows are each reported; a repeated item_id counts once; a very long text is
searched whole; without documents the result is empty, without items nothing is
hit. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm._shared import row_key, unused

#: Words of a window.
SIZE = 10
#: Windows that are broadcast at most; each takes some hundred bytes.
BROADCAST_WINDOWS = 200_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between words of a text as it is, capitals being letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The normalised words of a text."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, _SEPARATORS), lambda w: w != "")


def test_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, n, anchor, offset, gram): the distinct windows of items (item_id, text), each with its anchor word."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    at = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("i"))
    gram = at.select("item_id", F.slice("w", F.col("i"), size).alias("g"))
    ranked = F.array_sort(F.transform("g", lambda w, i: F.struct((-F.length(w)).alias("l"), w.alias("w"), i.alias("i"))))[0]
    return gram.select("item_id", F.size("g").alias("n"), ranked["w"].alias("anchor"), ranked["i"].alias("offset"), F.array_join("g", " ").alias("gram")).distinct()


def _small(df: DataFrame, is_small: bool) -> DataFrame:
    return F.broadcast(df) if is_small else df


def hits(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(k_id, k_text, start, n, item_id): every place of documents (doc_id, text) at which a window of an item begins."""
    windows = test_windows(items, size)
    is_small = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    anchors = windows.select("anchor").distinct()
    keyed = docs.where("text is not null").select("text", *row_key())
    # Which documents have an anchor at all, over all words; lowered as in words_of, as full lower case depends on what stands around a capital sigma.
    rough = keyed.select("k_id", "k_text", F.explode(F.split(F.translate("text", _UPPER, _LOWER), _SEPARATORS)).alias("word"))
    some = rough.join(_small(anchors.select(F.col("anchor").alias("word")), is_small), "word", "left_semi")
    some = some.select("k_id", "k_text").distinct()
    near = keyed.join(some, ["k_id", "k_text"], "left_semi").dropDuplicates(["k_id", "k_text"]).select("k_id", "k_text", words_of(F.col("text")).alias("w"))
    spots = near.select("k_id", "k_text", "w", F.posexplode("w").alias("pos", "anchor")).join(_small(anchors, is_small), "anchor", "left_semi")
    tried = spots.select("k_id", "k_text", "anchor", "pos", F.slice("w", F.greatest(F.col("pos") - size + 2, F.lit(1)), 2 * size - 1).alias("around"), F.greatest(F.col("pos") - size + 1, F.lit(0)).alias("from"))
    tried = tried.join(_small(windows, is_small), "anchor").where("pos >= offset")
    start = F.col("pos") - F.col("offset")
    found = tried.where(F.array_join(F.slice("around", start - F.col("from") + 1, F.col("n")), " ") == F.col("gram"))
    return found.select("k_id", "k_text", start.alias("start"), "n", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated), a row for each row of documents."""
    found = hits(docs, items, size)
    places = found.select("k_id", "k_text", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    n_hit = places.groupBy("k_id", "k_text").agg(F.count("*").alias("n_hit"))
    ids = found.select("k_id", "k_text", "item_id").distinct().groupBy("k_id", "k_text").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    counted = docs.select("doc_id", *row_key(), F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = counted.join(n_hit.join(ids, ["k_id", "k_text"]), ["k_id", "k_text"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents in which no window of an item occurs; all columns as they were."""
    a, b = unused(docs, "k_id"), unused(docs, "k_text")
    id_, text = row_key()
    gone = hits(docs, items, size).select(F.col("k_id").alias(a), F.col("k_text").alias(b)).distinct()
    return docs.withColumns({a: id_, b: text}).join(gone, [a, b], "left_anti").select(*docs.columns)


def without_spans(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Documents with the hit words cut from text, each with the separators after it; all else as it was."""
    a, b, n = unused(docs, "k_id"), unused(docs, "k_text"), unused(docs, "hit")
    id_, text = row_key()
    found = hits(docs, items, size).select(F.col("k_id").alias(a), F.col("k_text").alias(b), F.sequence(F.col("start"), F.col("start") + F.col("n") - 1).alias("at"))
    cut = found.groupBy(a, b).agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias(n))  # positions within one document
    pieces = F.regexp_extract_all("text", F.lit(rf"{_WORD}(?:{_BETWEEN})?"), F.lit(0))
    kept = F.filter(F.transform(pieces, lambda w, i: F.when(~F.array_contains(F.col(f"`{n}`"), i), w)), lambda w: w.isNotNull())
    rest = F.concat(F.regexp_extract("text", rf"^(?:{_BETWEEN})?", 0), F.array_join(kept, ""))
    joined = docs.withColumns({a: id_, b: text}).join(cut, [a, b], "left")
    return joined.withColumn("text", F.when(F.col(f"`{n}`").isNull(), F.col("text")).otherwise(rest)).select(*[F.col(f"`{c}`") for c in docs.columns])
