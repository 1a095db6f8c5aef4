"""Work and memory that grow no faster than the input."""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import search, transcript, vocabulary
from parley.streaming import live_segments as segments
from parley.streaming import live_words as live


class _Counted(str):
    """A word that counts how often it is read in lower case."""

    reads = 0

    def lower(self) -> str:
        _Counted.reads += 1
        return str.lower(self)


def _collapsed(words: list[str], least: int) -> list[str]:
    out: list[str] = []
    for w in words:
        out.append(w)
        for n in range(least, len(out) // 2 + 1):
            if [x.lower() for x in out[-n:]] == [x.lower() for x in out[-2 * n : -n]]:
                del out[-n:]
                break
    return out


def _trimmed(history: list[str], words: list[str], least: int) -> list[str]:
    for n in range(min(len(history), len(words)), least - 1, -1):
        if [h.lower() for h in history[-n:]] == [w.lower() for w in words[:n]]:
            return words[n:]
    return words


def test_repeats_are_those_of_all_lengths():
    """Against all lengths of run at each word, in texts of few words with runs said again."""
    r = random.Random(3)
    for _ in range(600):
        words = [r.choice("aAbcd"[: r.randint(1, 5)]) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            i, n = r.randint(0, len(words)), r.randint(1, 12)
            words[i:i] = words[max(0, i - n) : i]
        for least in (1, 2, 3, 6):
            assert live.collapsed(words, least) == _collapsed(words, least)
            cut = r.randint(0, len(words))
            assert live.overlap_trimmed(words[:cut], words[max(0, cut - 4) :], least) == _trimmed(words[:cut], words[max(0, cut - 4) :], least)


def test_long_turns_are_read_once():
    """A turn of 2000 words is put in lower case word by word, not run by run."""
    words = [_Counted(f"w{i % 701}-{i % 13}") for i in range(2000)]
    _Counted.reads = 0
    assert live.collapsed(words) == words and live.overlap_trimmed(words, words[1:]) == []
    assert _Counted.reads <= 3 * len(words)


def test_languages_split_a_text_once(spark):
    """The text is cut into words in one place of the plan; the first language by code wins among equals."""
    df = spark.createDataFrame([("the dog AND the cat",), ("der Hund und",), ("la",), ("",), (None,), ("un un el",), ("xyz theo",)], "t string").select(text.frequent_word_language("t").alias("g"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r["g"] for r in df.collect()] == ["en", "de", "es", None, None, "es", None]


class _Log:
    """Stands for a log of deltas and gives the function that is run on its batches."""

    def where(self, *_):
        return self

    repartition = sortWithinPartitions = select = where

    def mapInArrow(self, run, _):
        return run


def test_live_deltas_are_held_in_pieces():
    """A batch of 500 deltas gives its changes piece by piece, with one window over all of them."""
    word = lambda i: {"id": str(i), "text": f" w{i}", "start_ms": i * 300, "end_ms": i * 300 + 250, "channel": 0, "speaker_index": 0, "human": None}
    n = 500
    batch = pa.RecordBatch.from_pylist([{"transcript": 7, "seq": i, "new_words": [word(i)], "replaced_ids": [], "partials": []} for i in range(n)])
    pieces = list(segments.batch_changes(_Log())(iter([batch])))
    assert max(len(set(p.column("seq").to_pylist())) for p in pieces) < n / 10
    window, expected = segments.Window(), []
    for i in range(n):
        expected += window.apply(i, segments._words([word(i)]), [], [])
    got = [r for p in pieces for r in p.to_pylist()]
    assert [(r["seq"], r["change"], r["id"], r.get("text")) for r in got] == [(r["seq"], r["change"], r["id"], r.get("text")) for r in expected]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _corrected(said: str, aliases: list[tuple[str, str]]) -> tuple[str, int]:
    """Greedy correction of one text: longer runs first, left over right; canonicals stay."""
    names = {c.lower(): c for c, _ in aliases}
    table = {a: c for c, a in aliases if a not in names} | names
    tokens = re.split(r"[ \n]+", said)
    parts = [re.match(r"(?s)^([^a-zA-Z0-9]*)(.*?)([^a-zA-Z0-9]*)$", t).groups() for t in tokens]
    taken, at = set(), {}
    for n in (3, 2, 1):
        for i in range(len(tokens) - n + 1):
            run = range(i, i + n)
            key = " ".join(parts[k][1] for k in run).lower()
            if key in table and not taken & set(run) and not any(re.search(r"[.!?;:,]", parts[k][2]) for k in run[:-1]):
                taken |= set(run)
                if table[key].lower() != key:
                    at[i] = (n, parts[i][0] + table[key] + parts[i + n - 1][2])
    out, i = [], 0
    while i < len(tokens):
        n, new = at.get(i, (1, tokens[i]))
        out.append(new)
        i += n
    return " ".join(out), len(at)


def test_corrections_in_rows(spark):
    """Against one text at a time, on runs that touch and overlap; signs of a text that look like marks stay; few aliases are broadcast."""
    r = random.Random(5)
    aliases = [("ABC", "a b c"), ("Bc", "b c"), ("Ab", "a b"), ("X", "c"), ("b d", "e"), ("D a", "d"), ("Nothing", "a  b")]
    said = [" ".join(r.choice("(", ) * r.randint(0, 1) + r.choice("abcdeBD") + r.choice(["", "", "", ",", ".", ")"]) if r.random() < 0.9 else "-" for _ in range(r.randint(1, 40))) for _ in range(200)]
    said += ["a \x00b c", "", "a\nb   c"]
    docs = spark.createDataFrame([*enumerate(said), (-1, None)], "id long, text string")
    table = spark.createDataFrame(aliases, "canonical string, alias string")
    got = {x["id"]: (x["text"], x["n"]) for x in vocabulary.corrected(docs, table).collect()}
    assert got == {i: _corrected(t, aliases) for i, t in enumerate(said)}
    assert "strategy=broadcast" in _plan(vocabulary.replacements(docs, table))


def test_words_meet_their_neighbours_in_rows(spark):
    """Neither ordinary words nor candidates deal or sort the tokens of documents; a word counts once in a document, with any signs around it."""
    docs = spark.createDataFrame([(1, "So the (dog), dog! Dog. Then Kowalski and Dog"), (2, "the Dog dog"), (3, None), (4, "")], "id long, text string")
    ordinary = vocabulary.ordinary_words(docs)
    found = vocabulary.candidates(docs, ordinary)
    assert "Window" not in _plan(ordinary) + _plan(found)
    assert sorted(x[0] for x in ordinary.collect()) == ["dog", "the"]
    assert [tuple(x) for x in found.collect()] == [(1, 6, "Kowalski")]


def test_islands_are_measured_where_they_are(spark):
    """Words are not joined with the islands beyond the caps; hints of channels and speakers come by one join; a channel that is null is cut as well."""
    words = [(1, c, 0, i * 300, i * 300 + 250, f" w{i}") for c in (None, 0) for i in range(600)] + [(1, 1, s, i * 300, i * 300 + 250, f" v{i}") for i, s in enumerate((0, 0, 1, None))]
    w = spark.createDataFrame(words, "transcript long, channel int, speaker_index int, start_ms long, end_ms long, text string").withColumn("id", F.col("text"))
    hints = [(1, "channel", None, 0, None, "ada"), (1, "channel", None, 1, None, "bob"), (1, "speaker", None, 1, 1, "cyd"), (1, "speaker", None, 1, None, "dan"), (1, "word", " v0", None, None, "eve")]
    told = transcript.identities(w, spark.createDataFrame(hints, "transcript long, scope string, word_id string, channel int, speaker_index int, human string"))
    out = transcript.segments(told)
    assert "LeftAnti" not in _plan(out)
    got = {(x["channel"], x["speaker_index"], x["human"], x["start_ms"], x["n"]) for x in out.collect()}
    assert got == {(None, 0, None, 0, 512), (None, 0, None, 512 * 300, 88), (0, 0, "ada", 0, 512), (0, 0, "ada", 512 * 300, 88), (1, 0, "eve", 0, 1), (1, 0, None, 300, 1), (1, 1, "cyd", 600, 1), (1, None, None, 900, 1)}


def test_keywords_look_at_a_token_once(spark, monkeypatch):
    """A text that says the same words again is not taken apart again; what is remembered is bounded and changes no row."""
    looks = []
    core = search._core
    monkeypatch.setattr(search, "_core", lambda token: looks.append(token) or core(token))
    said = "the Fox, a fox! The the FOX? Big the x-y #tag_1 " * 200
    run = search.keywords(_Docs(), ("the", "a"))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": [said, said], "named": [["Fox"], None]})
    got = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert len(looks) <= len(set(search._TOKENS.findall(said)))
    monkeypatch.setattr(search, "KNOWN_TOKENS", 2)
    assert [r for b in run(iter([batch])) for r in b.to_pylist()] == got
    assert [(r["term"], r["n"]) for r in got if r["id"] == 2][:4] == [("tag_1", 0), ("Fox", 600), ("Big", 200), ("x-y", 200)]


class _Docs(_Log):
    """Documents with numbers as ids."""

    @property
    def schema(self):
        from pyspark.sql.types import LongType, StructField, StructType

        return StructType([StructField("id", LongType())])


def test_dense_pairs_are_those_of_a_join(spark):
    """Repeated rows, null keys, null values, keys of one side and lists of all lengths; one key's pairs lie in several tasks."""
    from parley.operators import relational as R

    r = random.Random(5)
    left = [(r.choice([None, 1, 1, 1, 2, 3]), r.choice("xy"), r.choice([None, *range(60)])) for _ in range(400)] + [(9, "x", 1)]
    right = [(r.choice([None, 1, 2, 4]), r.choice(["x", "y", None]), r.choice([None, *range(2000)])) for _ in range(1500)]
    a, b = spark.createDataFrame(left, "k long, kind string, a long"), spark.createDataFrame(right, "k long, kind string, b long")
    plain = a.join(b, ["k", "kind"]).groupBy("a", "b").count()
    for most in (1, 7, 4032):
        got = R.dense_join(a, b, ["k", "kind"], "a", "b", most=most)
        assert got.columns == ["a", "b"]
        assert got.groupBy("a", "b").count().exceptAll(plain).isEmpty() and plain.exceptAll(got.groupBy("a", "b").count()).isEmpty()
    one = R.dense_join(a.where("k = 1 and kind = 'x'"), b, ["k", "kind"], "a", "b", most=20, pairs_a_task=1000)
    held = [x["count"] for x in one.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 4 and max(held) < 3 * sum(held) / len(held)
    assert R.dense_join(a, b.where("k = 5"), ["k", "kind"], "a", "b").count() == 0


def test_pairs_of_sizes_take_little_disk(spark, tmp_path):
    """16 million pairs of one size are written in less than two bits each."""
    from parley.plans import catalog

    spark.range(4000).selectExpr("id * 7 as event_id", "'view' as event_type", """'{"k": 5}' as props""").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(4000).selectExpr("id * 3 as p_partkey", "5 as p_size", "'Brand#12' as p_brand").write.parquet(f"{tmp_path}/part.parquet")
    catalog.queries()["join_on_json"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 16_000_000
    assert sum(p.stat().st_size for p in tmp_path.glob("pairs/*.parquet")) < 16_000_000 * 2 / 8


def test_dense_pairs_are_passed_on_in_small_pieces(spark):
    """One pair of a million is asked for: a few thousand are made, not all that come from a pair of lists."""
    from parley.operators import relational as R

    a, b = spark.range(2000).selectExpr("1 as k", "id as a"), spark.range(500).selectExpr("1 as k", "id as b")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        first = R.dense_join(a, b, ["k"], "a", "b").limit(1)
        assert len(first.collect()) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    made, nodes = [], [first._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate":
            made.append(node.metrics().apply("numOutputRows").value())
    assert len(made) > 3 and 0 < max(made) <= 10_000
