"""Near duplicates, repeated passages, benchmark passages and vectors against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import decontaminate, minhash_dedup, substring_dedup, vector_dedup
from tests.llm import brute

WORDS = [f"w{i}" for i in range(60)] + ["Éa", "ÉA", "a b", "x-y", "Z"]


def corpus(seed: int = 3) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    base = [[r.choice(WORDS) for _ in range(r.randint(8, 60))] for _ in range(12)]
    docs: list[tuple[int, str | None]] = []
    for b in base:
        for _ in range(r.randint(1, 9)):
            w = [r.choice(WORDS) if r.random() < 0.03 else x for x in b]
            docs.append((len(docs) * 3 + 5, r.choice([" ", "\n", "\t "]).join(w)))
    passage = [r.choice(WORDS) for _ in range(20)]
    for _ in range(6):
        docs.append((len(docs) * 3 + 5, " ".join([r.choice(WORDS) for _ in range(9)] + passage + [r.choice(WORDS) for _ in range(5)])))
    extra = [None, "", " \n", "one", "ONE", "one two", "same same same same", "lone-word", " ".join(["again"] * 40), "long " * 3000]
    return docs + [(1000 + i, t) for i, t in enumerate(extra)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string")


@pytest.mark.parametrize(("shingle", "percent"), [(2, 80), (5, 80)])
def test_near_duplicates(docs, shingle, percent):
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(docs, shingle, percent).collect())
    assert got == brute.near_duplicates(corpus(), shingle, percent)


def test_blocks_lose_no_link(docs, monkeypatch):
    """Blocks of two documents: every comparison between blocks is needed."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2)
    monkeypatch.setattr(minhash_dedup, "ROUNDS", 0)
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(docs, 2, 80).collect())
    assert got == brute.near_duplicates(corpus(), 2, 80)


def test_deduplicate_keeps_columns_and_null_ids(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    got = sorted(minhash_dedup.deduplicate(df).collect(), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted([rows[0], rows[2], rows[3]], key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none, 5).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("size", [5, 12])
def test_repeated_passages(docs, size):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"] or "") for r in substring_dedup.remove_repeats(docs, size).collect())
    assert got == brute.repeats_removed(corpus(), size)


def test_full_sketch_loses_nothing(docs, monkeypatch):
    """A sketch of 64 cells estimates almost every window as repeated; the exact pass still decides."""
    monkeypatch.setattr(substring_dedup, "MOST_CELLS", 64)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"] or "") for r in substring_dedup.remove_repeats(docs, 12).collect())
    assert got == brute.repeats_removed(corpus(), 12)


@pytest.mark.parametrize("hot", [1, 4])
def test_spread_anchors_lose_nothing(docs, monkeypatch, hot):
    """All or the more frequent anchors count as hot; equal windows still meet."""
    monkeypatch.setattr(substring_dedup, "HOT_PLACES", hot)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"] or "") for r in substring_dedup.remove_repeats(docs, 12).collect())
    assert got == brute.repeats_removed(corpus(), 12)


def test_phrase_in_different_words_is_spread(spark, monkeypatch):
    """A phrase of 34 words in every document, other words around it: no bucket gets more than a few of its windows."""
    sent = []

    def counting(entries):
        n = sum(len(x.as_py()) for x in entries.column("multi"))
        return pa.table({"k_id": pa.array([str(n)]), "k_text": entries.column("bucket")[:1].cast(pa.int64()), "runs": pa.array([b""], pa.binary())})

    def watched(df):
        sent.extend(int(r["k_id"]) for r in df.select("k_id").collect())
        return df

    monkeypatch.setattr(substring_dedup, "_grouping", counting)
    monkeypatch.setattr(substring_dedup, "checkpointed", watched)
    phrase = " ".join(f"p{i}" for i in range(34))
    rows = [(d, " ".join([f"a{d}x{i}" for i in range(40)] + [phrase] + [f"b{d}x{i}" for i in range(40)])) for d in range(600)]
    substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(sent) > 600 and max(sent) < sum(sent) / 16


def test_repeats_keep_clashing_columns(spark):
    rows = [(1, "a b c d e f", 7, "k"), (1, "a b c d e f", 8, "k"), (2, None, 9, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long, runs string")
    got = sorted((r["doc_id"], r["n_words"], r["n_words_"], r["n_removed"], r["runs"], r["text"]) for r in substring_dedup.remove_repeats(df, 4).collect())
    assert got == [(1, 7, 6, 6, "k", ""), (1, 8, 6, 6, "k", ""), (2, 9, 0, 0, "k", None)]


def test_contamination(spark, docs):
    texts = corpus()
    w = brute.NORMAL.findall(texts[0][1])
    items = [(1, " ".join(w[:15]).upper()), (2, "one"), (3, None), (4, "!!"), (5, "nothing of the kind is in there at all , really not"), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, 10).withColumn("d", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256))
    rows = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["d"], r["contaminated"]) for r in got.collect())
    assert rows == brute.contamination(texts, items, 10)
    kept = {r["doc_id"] for r in decontaminate.keep_clean(docs, bench, 10).collect()}
    assert kept == {r[0] for r in rows if not r[5]}


@pytest.mark.parametrize("mark", [".", ":", "'"])
def test_contamination_before_a_mark(spark, mark):
    """Full lower case of a capital sigma depends on what follows the word's mark."""
    docs = spark.createDataFrame([(1, f"ΟΔΟΣ{mark}ΝΕΑ"), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ΟΔΟΣ")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()] == [2]


def test_vectors(spark, monkeypatch):
    r = np.random.default_rng(5)
    centre = r.normal(size=(20, 16))
    rows = [(i, (centre[i % 20] + r.normal(scale=0.12, size=16)).tolist(), int(i % 20) % 3) for i in range(600)]
    rows += [(900, [0.0] * 16, 1), (901, None, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, rows[0][1], 0), (905, [1e200] + [0.0] * 15, 2), (906, [2e200] + [0.0] * 15, 2), (907, [1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [(i, np.array(v) / np.abs(v).max(), c) for i, v, c in rows if c is not None and v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for k, (a, u, c) in enumerate(ok) for b, v, d in ok[k + 1 :] if c == d and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93]
    comp = brute.components([i for i, _, _ in rows], links)
    n = {i: sum(i in e for e in links) for i, _, _ in rows}
    expected = sorted((i, n[i], comp[i], comp[i] == i) for i, _, _ in rows)
    assert sorted(map(tuple, vector_dedup.near_vectors(df, 0.93).collect())) == expected
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    assert sorted(map(tuple, vector_dedup.near_vectors(df, 0.93, cell=25).collect())) == expected


def test_vectors_in_many_cells(spark, monkeypatch):
    """All of the 64-dimensional vectors as one label, in about 40 cells: no pair is lost."""
    monkeypatch.setattr(vector_dedup, "DEALT", 500)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", F.lit(1).alias("label"))
    rows = df.collect()
    u = np.array([r["embedding"] for r in rows], dtype=float)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    for threshold in (0.93, 0.6):
        near = u @ u.T >= threshold
        np.fill_diagonal(near, False)
        got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(df, threshold, cell=50).collect()}
        assert [got[r["vec_id"]] for r in rows] == near.sum(axis=1).tolist()


def test_vectors_repeated_ids_and_ties(spark):
    """One id for two vectors, an exact tie at the threshold, and a column that the operator makes itself."""
    rows = [(1, [1.0, 0.0], 7, "x"), (1, [0.0, 1.0], 7, "x"), (2, [1.0, 0.0], 7, "y"), (3, [0.0, 2.0], 7, "z"), (4, [3.0, 4.0], 8, "t"), (5, [1.0, 0.0], 8, "t")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, unit string")
    got = sorted(map(tuple, vector_dedup.near_vectors(df, 0.6).collect()))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False)]


def test_clashing_columns_stay(spark):
    """Columns with the names of what the operators add in between."""
    rows = [(1, "a b c d e f", "i", "t", "h"), (2, "a b c d e f", "i", "t", "h"), (2, "x a b c d e f", "i", "t", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k_id string, k_text string, hit string")
    got = substring_dedup.remove_repeats(df, 4)
    assert got.columns == [*df.columns, "n_words", "n_removed"] and sorted(r["n_removed"] for r in got.collect()) == [6, 6, 6]
    items = spark.createDataFrame([(1, "C d")], "item_id long, text string")
    assert decontaminate.keep_clean(df, items).count() == 0
    cut = decontaminate.without_spans(df, items)
    assert cut.columns == df.columns and sorted(r["text"] for r in cut.collect()) == ["a b e f", "a b e f", "x a b e f"]


def test_spans_go_with_their_separators(spark):
    rows = [(1, "..One, two; THREE four!"), (2, "one"), (3, None), (4, "two one three"), (1, "..One, two; THREE four!")]
    items = spark.createDataFrame([(1, "two three"), (2, "Four")], "item_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in decontaminate.without_spans(spark.createDataFrame(rows, "doc_id long, text string"), items).collect())
    assert got == [(1, "..One, "), (1, "..One, "), (2, "one"), (3, None), (4, "two one three")]


def test_folding_is_the_same_on_both_sides(spark):
    """Lower case of a capital sigma depends on what stands around it; only A-Z is lowered."""
    docs = spark.createDataFrame([(1, "ΑΣ'Α ist da"), (2, "ΑΣ x"), (3, "ας")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ΑΣ")], "item_id long, text string")
    assert sorted((r["doc_id"], r["n_hit"]) for r in decontaminate.contamination(docs, items).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_near_duplicates_with_one_id_twice(spark):
    """Rows that repeat a doc_id are one node, which links by any of its texts."""
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "p q r s t u v"), (9, "p q r s t u v"), (9, "p q r s t u v"), (7, "lone text of its own here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (7, 7)}


def test_divergence_holds_few_keys():
    """What a task of op13 holds of hashes and counts before it gives them out: some 8 MB of keys, and 100,000 rows."""
    from parley.llm import divergence

    assert divergence.HELD_KEYS * 8 <= 8_000_000 and divergence.HELD_ROWS <= 100_000
