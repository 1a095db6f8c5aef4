"""Language, quality and toxicity: held-out accuracy, and defined results on the edges."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import _text as X
from parley.llm import langid, quality, toxicity
from parley.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.01"
EDGES = [None, "", " ", "1234 !!", "x", "word " * 20000, "퟿\U0001f600 é", "a\x00b"]


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


@pytest.mark.parametrize(("name", "label", "mod", "rest", "least"), [("op2_quality", "quality", 5, 0, 0.95), ("op7_toxicity", "toxic", 3, 1, 0.93)])
def test_held_out_accuracy(spark, labels, name, label, mod, rest, least):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) for r in rows)
    judged = [(r["predicted"], labels[r["doc_id"]][label]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in judged]) >= least


def test_language_accuracy(spark):
    rows = QUERIES["op9_language_id"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges_are_scored(spark):
    docs = spark.createDataFrame(list(enumerate(EDGES)), "doc_id long, text string").withColumn("score", F.lit("mine"))
    train = spark.createDataFrame([(i, "good words here" if i % 2 else "$$ %% ##", "en" if i % 2 else "de") for i in range(100, 160)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(100, 160)], "doc_id long, quality int, toxic int")
    for module, column in ((quality, "quality_score"), (toxicity, "toxicity")):
        model = module.fit(train.select("doc_id", "text"), marks, F.lit(True))
        got = module.score(docs, model).orderBy("doc_id").collect()
        assert [r["score"] for r in got] == ["mine"] * len(EDGES) and all(0 <= r[column] <= 1 for r in got)
        assert module.fit(train.select("doc_id", "text"), marks.where("false"), F.lit(True)) is None
        assert {r["score"] for r in module.predict(docs.drop("score"), None).collect()} == {0.5 if module is quality else 0.0}
    model = langid.fit(train, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score_"]) for r in langid.identify(docs, model).collect()}
    assert [got[i][0] for i in (0, 1, 2, 3)] == ["und"] * 4 and all(0 <= s <= 1 for _, s in got.values())
    assert langid.fit(train.where("false"), F.lit(True)) is None


def test_one_class_gives_its_share():
    x = np.random.default_rng(1).normal(size=(30, len(quality.FEATURES)))
    model = quality.train(x, np.ones(30), np.ones(30))
    assert np.allclose(model.score(x), (30 + 0.5 * 1) / 31, atol=0.05)


def test_isotonic_never_falls():
    r = np.random.default_rng(2)
    raw, y = r.normal(size=200), r.integers(0, 2, 200).astype(float)
    at, p = toxicity.isotonic(raw, y, np.ones(200))
    assert (np.diff(p) >= 0).all() and (np.diff(at) >= 0).all() and p.min() > 0 and p.max() < 1


def test_scores_add_up_from_tables():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.train(x, y, np.ones(400))
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_code_lengths_are_exact():
    """The tables give the same code as coding byte by byte with escapes, also for bytes that one language or none has seen."""
    trained = {"a": ["abracadabra abracadabra", "cad", "é"], "b": ["zzz xyz", ""]}
    model = langid.train({k: pa.array(v) for k, v in trained.items()})
    texts = ["abra", "zz", "", "abracadabra xyz é", "a", "zyx cadabra" * 50, "q", "é", "aq", "abraqé", "\x00\u0394\U0001f600", "xy\x7f" * 30]
    bits = langid.code_lengths(model, X.texts_of(pa.array(texts)))
    for j, name in enumerate(model.langs):
        want = [brute.code_length([t.encode() for t in trained[name]], t.encode()) for t in texts]
        assert np.allclose(bits[:, j], want, atol=1e-4)


def test_all_bytes_are_told_apart():
    """Training on texts of very many different bytes: each context knows them all."""
    every = "".join(map(chr, range(1, 0x250))) + "".join(chr(c) for c in range(0x300, 0x11000, 97) if not 0xD800 <= c < 0xE000)
    trained = {"a": [every, every[::2]], "b": [every[::3]]}
    model = langid.train({k: pa.array(v) for k, v in trained.items()})
    texts = [every[5:90], every[::7], every[-40:], "plain"]
    bits = langid.code_lengths(model, X.texts_of(pa.array(texts)))
    for j, name in enumerate(model.langs):
        assert np.allclose(bits[:, j], [brute.code_length([t.encode() for t in trained[name]], t.encode()) for t in texts], rtol=1e-5)


def test_equal_code_lengths_go_by_name(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs, F.lit(True))).collect()} == {"a"}


def test_empty_and_repeated_rows(spark):
    """Empty tables are answered, and rows that repeat are each answered alike."""
    rows = [(i, "good words here" if i % 2 else "$$ %% ##", "en" if i % 2 else "de") for i in [*range(40), 7, 7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.fit(docs, marks, F.lit(True))
        assert module.predict(docs.where("false"), model).count() == 0
        assert len({r["score"] for r in module.predict(docs, model).where("doc_id = 7").collect()}) == 1
        assert module.predict(docs, model).where("doc_id = 7").count() == 3
        clash = docs.withColumn("quality_score", F.lit("q")).withColumn("toxicity", F.lit("t"))
        assert module.score(clash, model).columns[-1] in ("quality_score_", "toxicity_")
    model = langid.fit(docs, F.lit(True))
    assert langid.identify(docs.where("false"), model).count() == 0
    assert len({tuple(r) for r in langid.predict(docs, model).where("doc_id = 7").collect()}) == 1
