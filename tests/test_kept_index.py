"""The kept index: batches, restarts, replays, what is read and written, and searches against brute force."""

from __future__ import annotations

import math
import os
import random
import re

import pytest

from parley.operators.kept_index import KeptIndex, bucket_of, kept
from parley.streaming.search_index import IndexMaintainer

SCHEMA = "id long, title string, content string"


def words(text):
    return [w for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if w]


def table(docs: dict) -> list:
    return [(i, t, c) for i, (t, c) in docs.items()]


def told(index) -> set:
    return {(r["id"], r["field"], r["term"], r["tf"], tuple(r["positions"]), r["length"]) for r in index.postings().collect()}


def brute(docs: dict) -> set:
    out = set()
    for i, fields in docs.items():
        for f, text in zip(("title", "content"), fields, strict=True):
            own = words(text)
            out |= {(i, f, t, own.count(t), tuple(k for k, w in enumerate(own) if w == t), len(own)) for t in own}
    return out


def bm25(docs: dict, terms, field: int) -> dict:
    lists = {i: words(d[field]) for i, d in docs.items()}
    n, mean = len(lists), sum(map(len, lists.values())) / len(lists)
    score: dict = {}
    for t in set(terms):
        hits = {i: w.count(t) for i, w in lists.items() if t in w}
        for i, tf in hits.items():
            score[i] = score.get(i, 0) + math.log(1 + (n - len(hits) + 0.5) / (len(hits) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(lists[i]) / mean))
    return score


@pytest.fixture(scope="module")
def docs() -> dict:
    rng = random.Random(3)
    return {i: (rng.choice(["Alpha", "beta, gamma!", "", None]), " ".join(rng.choice("red green blue the a of rare".split()[: rng.choice([3, 6, 7])]) for _ in range(rng.randrange(12)))) for i in range(60)}


def test_batches_restarts_and_replays(spark, tmp_path, docs):
    now = dict(docs)
    KeptIndex(spark, str(tmp_path)).build(spark.createDataFrame(table(now), SCHEMA))
    assert told(KeptIndex(spark, str(tmp_path))) == brute(now)
    rng = random.Random(5)
    for batch in range(3):
        changed = {i: ("new title", f"fresh words {batch} red") for i in rng.sample(range(80), 4)}
        gone = [i for i in rng.sample(range(60), 3) if i not in changed]
        now = {i: d for i, d in (now | changed).items() if i not in gone}
        index = KeptIndex(spark, str(tmp_path))  # as after a restart
        for _ in range(2):  # the second is a replay
            index.update(spark.createDataFrame(table(changed), SCHEMA), spark.createDataFrame([(i,) for i in gone], "id long"), batch)
        assert index.versions()[-1] == batch + 2
    assert told(index) == brute(now)
    got = {r["id"]: r["score"] for r in index.any_of(["red", "fresh", "nowhere"], {"content": 1.0}).collect()}
    want = bm25(now, ["red", "fresh"], 1)
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in want)
    assert index.vacuum(keep=1) > 0 and told(KeptIndex(spark, str(tmp_path))) == brute(now)


def test_only_touched_buckets_are_written_and_read(spark, tmp_path, docs):
    index = KeptIndex(spark, str(tmp_path)).build(spark.createDataFrame(table(docs), SCHEMA))
    before = index.manifest()["tables"]
    index.update(spark.createDataFrame([(7, docs[7][0], (docs[7][1] or "") + " singular")], SCHEMA), spark.createDataFrame([], "id long"))
    after = index.manifest()["tables"]
    touched = {r["b"] for r in spark.createDataFrame([(w,) for w in {*words(docs[7][0]), *words(docs[7][1]), "singular"}], "t string").select(bucket_of("t", 16).alias("b")).collect()}
    assert {b for b in after["postings"] if after["postings"][b] != before["postings"].get(b)} == touched
    assert len([b for b in after["documents"] if after["documents"][b] != before["documents"].get(b)]) == 1
    files = index.postings(["singular"]).inputFiles()
    assert len({os.path.dirname(f) for f in files}) == 1 and index.postings(["singular"]).count() == 1


def test_an_unfinished_manifest_does_not_count(spark, tmp_path, docs):
    index = KeptIndex(spark, str(tmp_path)).build(spark.createDataFrame(table(docs), SCHEMA))
    os.makedirs(tmp_path / "manifest" / "00000002-half")
    assert index.versions() == [1] and told(index) == brute(docs)


def test_two_writers_do_not_mix(spark, tmp_path, docs, monkeypatch):
    """Two builds of one version: each reads whole; an update beside another one fails and leaves a whole index."""
    df = spark.createDataFrame(table(docs), SCHEMA)
    index = KeptIndex(spark, str(tmp_path))
    monkeypatch.setattr(KeptIndex, "versions", lambda self: [])
    index.build(df)
    index.build(df)
    monkeypatch.undo()
    assert index.versions() == [1] and len(os.listdir(tmp_path / "manifest")) == 2 and told(index) == brute(docs)
    late = index.manifest()
    index.update(df.where("id = 1"), df.select("id").where("id = 2"))
    monkeypatch.setattr(KeptIndex, "manifest", lambda self: late)
    with pytest.raises(RuntimeError):
        index.update(df.where("id = 1"), df.select("id").where("id = 2"))
    monkeypatch.undo()
    assert told(index) == brute({i: d for i, d in docs.items() if i != 2})


@pytest.mark.parametrize(("terms", "slop"), [(["red", "green"], 0), (["red", "red"], 0), (["red", "green", "blue"], 2), (["red", "the", "red"], 3), (["rare"], 0), (["red", "nowhere"], 5)])
def test_phrases(spark, tmp_path, docs, terms, slop):
    index = KeptIndex(spark, str(tmp_path)).build(spark.createDataFrame(table(docs), SCHEMA))

    def there(own) -> bool:
        def ends(k, at):
            return [at] if k == len(terms) else [e for p, w in enumerate(own) if w == terms[k] and p > at for e in ends(k + 1, p)]

        return any(e - s <= len(terms) - 1 + slop for s, w in enumerate(own) if w == terms[0] for e in ends(1, s))

    assert {r["id"] for r in index.phrase(terms, "content", slop).collect()} == {i for i, d in docs.items() if there(words(d[1]))}


def test_all_of_counts_titles(spark, tmp_path, docs):
    index = KeptIndex(spark, str(tmp_path)).build(spark.createDataFrame(table(docs), SCHEMA))
    got = {r["id"] for r in index.all_of(["gamma", "red"], {"title": 3.0, "content": 1.0}).collect()}
    assert got == {i for i, d in docs.items() if all(t in words(d[0]) + words(d[1]) for t in ("gamma", "red"))}


def test_kept_by_its_files(spark, tmp_path, docs):
    source = str(tmp_path / "docs")
    spark.createDataFrame(table(docs), SCHEMA).write.parquet(source)
    first = kept(spark, str(tmp_path / "index"), spark.read.parquet(source))
    again = kept(spark, str(tmp_path / "index"), spark.read.parquet(source))
    assert again.path == first.path and again.versions() == [1]
    spark.createDataFrame([(99, "x", "added")], SCHEMA).write.mode("append").parquet(source)
    assert kept(spark, str(tmp_path / "index"), spark.read.parquet(source)).path != first.path


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = KeptIndex(spark, str(tmp_path)).build(none)
    assert told(index) == set() and index.any_of(["x"], {"content": 1.0}).count() == 0
    index.update(none, none.select("id"))
    index.update(spark.createDataFrame([(1, None, None), (2, "t", "x x")], SCHEMA), none.select("id"))
    assert [r["id"] for r in index.any_of(["x"], {"content": 1.0}).collect()] == [2] and index.manifest()["sums"]["content"] == [2, 2]


def test_a_stream_of_dirty_entities(spark, tmp_path):
    """The latest generation of an id counts; a maintainer that starts anew goes on."""
    now = {1: ("a", "one two"), 2: ("b", "two")}
    index = KeptIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame(table(now), SCHEMA))
    dirty, state = str(tmp_path / "dirty"), str(tmp_path / "state")
    schema = "id long, generation long, removed boolean"
    source = {"d": now}
    batches = [([(1, 1, False), (2, 1, True), (3, 2, False), (3, 1, True)], {1: ("a", "three"), 3: ("c", "four")}), ([(3, 4, True), (3, 3, False)], {1: ("a", "three")})]
    for rows, after in batches:
        source["d"] = after
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(dirty)
        m = IndexMaintainer(KeptIndex(spark, str(tmp_path / "index")), lambda: spark.createDataFrame(table(source["d"]), SCHEMA))
        m.follow(spark.readStream.schema(schema).parquet(dirty), state).trigger(availableNow=True).start().awaitTermination()
        assert told(index) == brute(after)
    assert index.manifest()["batch"] == 1


def test_snippets_take_the_heaviest_window(spark, tmp_path):
    """The window with both terms, the first of equal ones, and the words before it."""
    texts = {1: "a b red c d e f g h red green i j", 2: "Green! x, red red", 3: "green " + "y " * 30 + "Green z", 4: "nothing", 5: None}
    df = spark.createDataFrame([(i, None, t) for i, t in texts.items()], SCHEMA)
    index = KeptIndex(spark, str(tmp_path)).build(df)
    got = {r["id"]: (r["fragment"], r["hits"]) for r in index.snippets(["red", "green"], "content", df, width=4, lead=1).collect()}
    assert got == {1: ("h red green i j", [1, 2]), 2: ("Green x red red", [0, 2, 3]), 3: ("green y y y y", [0])}


def test_postings_are_made_in_pieces(spark, monkeypatch):
    """Pieces of a few words give the rows of a whole batch: documents longer than a piece, empty ones and nulls as well."""
    from parley.operators import kept_index

    docs = spark.createDataFrame([(i, "" if i % 4 == 0 else None if i % 7 == 0 else " ".join(f"w{j % 3} x{i}" for j in range(i))) for i in range(20)], "id long, content string").coalesce(1)
    told = lambda: sorted(map(tuple, kept_index.postings(docs, ["content"]).collect()), key=repr)
    whole = told()
    monkeypatch.setattr(kept_index, "PIECE_WORDS", 5)
    assert told() == whole and len(whole) > 20
