"""Prefix tries and source audits against brute force, on hot groups and on the edges."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from parley.llm import divergence, prefix_trie
from parley.llm.queries import ORACLE_SQL, QUERIES, rebuilt
from tests.conftest import same_rows
from tests.llm import brute

TURNS = "conv_id long, turn long, role string, text string"


def rows_of(sequences: dict) -> list:
    return [(c, k, r, t) for c, turns in sequences.items() for k, (r, t) in enumerate(turns)]


def got(df) -> set:
    rows = [tuple(r[c.split()[0]] for c in prefix_trie.NODE.split(", ")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def conversations() -> dict:
    """Copies of one conversation, a prefix of twelve turns that many share, one first turn of a third of all, and others."""
    rng = random.Random(4)
    turn = lambda: (rng.choice(["user", "assistant"]), rng.choice(["é", "b", "", "long " * 40]) + str(rng.randrange(3)))
    shared = [("user", f"s{k}") for k in range(12)]
    out: dict = {}
    for k in range(240):
        kind = k % 6
        if kind == 0:
            out[k] = [("user", "same"), ("assistant", "same"), ("user", "end")]
        elif kind == 1:
            out[k] = shared + [turn() for _ in range(rng.randrange(4))]
        elif kind == 2:
            out[k] = shared[: rng.randrange(1, 13)]
        elif kind == 3:
            out[k] = [("user", "hot")] + [turn() for _ in range(rng.randrange(6))]
        else:
            out[k] = [turn() for _ in range(rng.randrange(1, 7))]
    return out


@pytest.mark.parametrize("least", [1, 40, 10**6])
def test_trie_at_any_size_of_bucket(spark, conversations, monkeypatch, least):
    """Buckets of one turn, of forty, and one for all give the same nodes."""
    monkeypatch.setattr(prefix_trie, "LEAST_BUCKET", least)
    monkeypatch.setattr(prefix_trie, "MOST_BUCKET", least)
    monkeypatch.setattr(prefix_trie, "DIGEST_PART", 7)
    turns = spark.createDataFrame(rows_of(conversations), TURNS).repartition(5)
    assert got(prefix_trie.prefix_trie(turns)) == brute.trie(conversations)


def test_trie_where_all_begin_alike(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_BUCKET", 2)
    monkeypatch.setattr(prefix_trie, "MOST_BUCKET", 2)
    same = {k: [("u", "a"), ("v", "b"), ("u", "c")] + [("v", str(k))] * (k % 3) for k in range(9)}
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows_of(same), TURNS))) == brute.trie(same)


def test_trie_edges(spark):
    rows = [
        (1, None, None, "first"), (1, 5, "u", None), (1, 2, "u", "x"), (1, 2, "u", "x"),  # null turn first, repeated rows
        (None, 0, "u", "gone"), (2, 0, "", "first"), (-3, 0, "1:", "a"), (-4, 0, "1", ":a"),  # role and text are not run together
        (5, 0, "u", "word " * 200_000),
    ]
    df = spark.createDataFrame(rows, TURNS).withColumn("ids", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("depth", F.lit(2))
    want = {1: [("", "first"), ("u", "x"), ("u", "x"), ("u", "")], 2: [("", "first")], -3: [("1:", "a")], -4: [("1", ":a")], 5: [("u", "word " * 200_000)]}
    assert got(prefix_trie.prefix_trie(df)) == brute.trie(want)
    assert got(prefix_trie.prefix_trie(df.where("false"))) == set()
    # Conversations may end in the root.
    empty = spark.createDataFrame([(4, [], []), (7, [], []), (9, [1], [3])], "conv_id long, ids array<long>, sizes array<long>")
    assert {r[:6] for r in got(prefix_trie.trie(empty))} == {(4, 0, None, 3, 1, 1), (9, 1, 4, 1, 0, 1)}


def test_trie_of_rebuilt_conversations(spark, duck, sf_dir):
    same_rows(QUERIES["op12_prefix_trie"](spark, sf_dir), duck, ORACLE_SQL["op12_prefix_trie"])
    told = {c: [("u", f"{c}.{k}") for k in range(c % 11)] for c in [*range(3, 40), -1, -5, 52]}
    want = {c: (told.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[: (h := zlib.crc32(str(c).encode()) % 9)]) + told[c][h:] for c in told if told[c]}
    seqs = prefix_trie.encoded(spark.createDataFrame(rows_of(told), TURNS))
    assert got(prefix_trie.trie(rebuilt(seqs))) == brute.trie(want)


DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def documents() -> list:
    rng = random.Random(9)
    words = [f"W{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(60)]
    out = []
    for k in range(160):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("en", "Ü"), ("en", None), ("de", "a"), (None, "x"), ("it", "y"), ("it", "z")])
        text = " ".join(rng.choice(words[: rng.choice([5, 60])]) + rng.choice(["", "7", "-", "ÄA"]) for _ in range(rng.randrange(40)))
        out.append((k, rng.choice([text, text, text, None if k % 9 == 0 else text]), lang, source))
    return [*out, *out[:6], (900, "only here", "fr", "lone"), (901, "", "it", "y")]


def test_divergence_is_exact(spark, documents, monkeypatch):
    """Also where the sketch is so small that most cells are shared."""
    want = brute.divergence([d[1:] for d in documents])
    assert any(r[2] == "term" for r in want)
    df = spark.createDataFrame(documents, DOCS).withColumn("term", F.lit("mine")).withColumn("n", F.lit(1)).repartition(7)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    for cells in (1 << 20, 32):
        monkeypatch.setattr(divergence, "BLOCK", cells)
        monkeypatch.setattr(divergence, "MOST_CELLS", cells)
        monkeypatch.setattr(divergence, "HELD_ROWS", 50)
        monkeypatch.setattr(divergence, "HELD_KEYS", 200)
        monkeypatch.setattr(divergence, "BROADCAST_SOURCES", 20_000 if cells > 32 else 0)
        assert {tuple(r[c] for c in columns) for r in divergence.audit(df).collect()} == want


def test_sketch_never_underestimates(spark, documents):
    df = spark.createDataFrame(documents, DOCS).select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]).repartition(3)
    kept = {(r["lang"], r["source"], r["term"]): r["n"] for r in divergence.counts(df, 1).collect()}
    for least in (2, 10, 25):
        some = {(r["lang"], r["source"], r["term"]): r["n"] for r in divergence.counts(df, least).collect()}
        assert some.items() <= kept.items() and len(some) < len(kept)


def test_sketch_drops_terms_before_the_shuffle(spark):
    """Of 5000 terms that occur once and 50 that occur often, hardly any of the former is sent on."""
    df = spark.createDataFrame([("en", "s", " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(50)) + " " + " ".join("x" + "".join("abcdefghij"[int(c)] for c in str(d * 250 + j)) for j in range(250))) for d in range(20)], "lang string, source string, text string")
    width = divergence.BLOCK
    planes = spark.sparkContext.broadcast(divergence.sketch(df, 10, width, 2))
    sent = df.mapInArrow(divergence._counting(width, planes), divergence._COUNTS).select("term").distinct().count()
    assert 50 <= sent <= 80


def test_divergence_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "a " * 100_000, "x", "s")], DOCS)
    assert divergence.audit(df).count() == 0  # no other source of a language, no term of ten documents
    assert divergence.audit(df.where("false")).count() == 0
    two = spark.createDataFrame([(1, None, "x", "s"), (2, "a b", "x", "t")], DOCS)
    assert {tuple(r) for r in divergence.audit(two).collect()} == {("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)}


def test_rates_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, total long, kinds long")
    assert big.select(divergence._rate(F.col("n"), "total", "kinds")).first()[0] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 14)


def test_divergence_equals_its_sql(spark, duck, sf_dir):
    same_rows(QUERIES["op13_source_divergence"](spark, sf_dir), duck, ORACLE_SQL["op13_source_divergence"])
