"""Live segments: the stream gives the changes of the batch form, both those of a plain reading; bounds; folds of delta logs."""

from __future__ import annotations

import random


from parley.operators import deltas as D
from parley.streaming import live_segments as L
from parley.streaming.alarms import keyed_state


def word(i, start, end=None, text=None, channel=0, speaker=None, human=None):
    return {"id": i, "text": f" {i}" if text is None else text, "start_ms": start, "end_ms": end or start + 200, "channel": channel, "speaker_index": speaker, "human": human}


def partial(text, start, end=None, channel=0):
    return {"text": text, "start_ms": start, "end_ms": end or start + 200, "channel": channel}


def ids(changes):
    return [(c["change"], c["id"]) for c in changes]


def apply(window, seq, new=(), replaced=(), partials=()):
    return window.apply(seq, L._words(list(new)), list(replaced), L._words(list(partials)))


def test_changes_of_one_transcript():
    w = L.Window()
    assert ids(apply(w, 1, [word("a", 0), word("b", 300)])) == [("upsert", "0:none:none:a:b")]
    assert apply(w, 1, [word("x", 0)]) == []  # a replay
    assert ids(apply(w, 2, partials=[partial(" c", 600)])) == [("upsert", "0:none:none:a:end:800"), ("remove", "0:none:none:a:b")]
    assert ids(apply(w, 3)) == [("upsert", "0:none:none:a:b"), ("remove", "0:none:none:a:end:800")]
    assert apply(w, 4) == []
    got = apply(w, 5, [word("d", 300, text=" D")], replaced=["b"])
    assert ids(got) == [("upsert", "0:none:none:a:d"), ("remove", "0:none:none:a:b")] and got[0]["text"] == "a D"
    assert ids(apply(w, 6, [word("d", 300, text=" E")])) == [("upsert", "0:none:none:a:d")]  # the same id, another revision
    assert ids(apply(w, 7, replaced=["a", "d"])) == [("remove", "0:none:none:a:d")]


def test_segments_by_identity():
    said = lambda *words: [(s[0], s[1], s[2], [w.id for w in s[3]]) for s in L.segments_of(sorted(L._words(words)), [])]
    assert said(word("a", 0), word("b", 3_200), word("c", 6_500)) == [(0, None, None, ["a", "b"]), (0, None, None, ["c"])]
    assert said(word("a", 0, speaker=1), word("x", 100, channel=1), word("b", 300, speaker=1), word("c", 600, speaker=2)) == [(0, 1, None, ["a", "b"]), (1, None, None, ["x"]), (0, 2, None, ["c"])]
    # One human with two speaker numbers is one; a key without identity is joined by gap only, not again.
    assert said(word("a", 0, speaker=1, human="h"), word("b", 300, speaker=2, human="h")) == [(0, 1, "h", ["a", "b"])]
    many = [word(f"w{i:04d}", i * 10, i * 10 + 5) for i in range(1_030)]
    assert [len(s[3]) for s in L.segments_of(sorted(L._words(many)), [])] == [512, 512, 6]
    slow = [word(f"w{i:04d}", i * 2_000, i * 2_000 + 500) for i in range(200)]
    assert [len(s[3]) for s in L.segments_of(sorted(L._words(slow)), [])] == [150, 50]


def test_partials_take_the_last_identity():
    s = L.segments_of(sorted(L._words([word("a", 0, speaker=3, human="h")])), L._words([partial(" p", 300), partial(" q", 9_000), partial(" r", 0, channel=1)]))
    assert [(x[0], x[1], x[2], len(x[3])) for x in s] == [(0, 3, "h", 2), (1, None, None, 1), (0, 3, "h", 1)]


def test_bounds_of_the_window():
    w = L.Window()
    apply(w, 1, [word(f"w{i:05d}", i * 100) for i in range(5_000)])
    assert len(w.words) == L.WINDOW_WORDS and w.words[0].id == "w00904"
    apply(w, 2, [word("late", 3_000_000)])
    assert [x.id for x in w.words] == ["late"]  # all others end more than half an hour before
    w = L.Window()
    apply(w, 1, [word(f"w{i}", i * 100, text="é" * 10_000) for i in range(5)])
    assert [x.id for x in w.words] == ["w2", "w3", "w4"]
    apply(w, 2, [word("huge", 900, text="é" * 100_000)])
    assert [(x.id, len(x.text.encode())) for x in w.words] == [("huge", 65_536)]
    assert L.shown_partials(L._words([partial("abc", 0), partial("def", 10)]), 210, 5, 4) == L._words([partial("a", 0), partial("def", 10)])
    assert L.shown_partials(L._words([partial("abc", 0), partial("def", 10)]), 210, 1, 99) == L._words([partial("def", 10)])


def log(n=60, seed=2):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        t, at = seq % 4, seq * 700
        new = [word(f"{t}.{rng.randrange(40)}", at + k * 300, channel=rng.randrange(2), speaker=rng.choice([None, 0, 1]), human=rng.choice([None, None, "h"])) for k in range(rng.randrange(4))]
        rows.append((t, seq, new, [f"{t}.{rng.randrange(40)}" for _ in range(rng.randrange(3))], [partial(" p", at + 2_000, channel=rng.randrange(2))] * rng.randrange(2)))
    return [*rows, *rng.sample(rows, 9), (5, 0, None, None, None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = log()
    want = {}
    for t in {r[0] for r in rows}:
        w = L.Window()
        want[t] = [c for r in sorted((r for r in rows if r[0] == t), key=lambda r: r[1]) for c in apply(w, r[1], r[2] or (), r[3] or (), r[4] or ())]
    told = lambda df: sorted(map(str, df.collect()))
    batch = L.batch_changes(spark.createDataFrame(rows, L.DELTA))
    assert batch.count() == sum(map(len, want.values()))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, L.DELTA).coalesce(1).write.mode("append").parquet(folder)
        with keyed_state(spark):
            changes = L.stream_changes(spark.readStream.schema(L.DELTA).parquet(folder))
            changes.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    assert told(spark.read.schema(L.CHANGE).parquet(out)) == told(batch)
    # What stands after all changes is what the last window shows.
    now = {(r["transcript"], r["id"]) for r in L.current(batch).collect()}
    for t in want:
        w = L.Window()
        for r in sorted((r for r in rows if r[0] == t), key=lambda r: r[1]):
            apply(w, r[1], r[2] or (), r[3] or (), r[4] or ())
        assert {i for x, i in now if x == t} == set(w.revisions)


def test_folds_of_a_log(spark):
    rows = log(80, 7)
    words: dict = {}
    for t, seq, new, replaced, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        for i in [*(replaced or []), *(w["id"] for w in new or [])]:
            words.pop((t, i), None)
        for w in new or []:
            words[t, w["id"]] = w | {"seq": seq}
    df = spark.createDataFrame(rows, L.DELTA)
    got = {(r["transcript"], r["id"]): r for r in D.folded_words(df).collect()}
    assert got.keys() == words.keys() and all(got[k]["start_ms"] == words[k]["start_ms"] for k in words if sum(1 for r in rows if r[0] == k[0] and r[1] == words[k]["seq"] for w in r[2] if w["id"] == k[1]) == 1)
    small = D.compacted(df, 40)
    assert {(r["transcript"], r["id"]) for r in D.folded_words(small).collect()} == set(words) and small.where("seq <= 40").count() <= 5
    assert sorted(map(str, D.folded_partials(small).collect())) == sorted(map(str, D.folded_partials(df).collect()))


def test_hints_of_replaced_words_go(spark):
    w = lambda i, speaker=None: word(i, 0, speaker=speaker)
    df = spark.createDataFrame([(1, 1, [w("a", 0), w("b"), w("c")], [], []), (1, 3, [w("d", 1)], ["a", "b"], []), (1, 4, [w("c")], [], [])], L.DELTA)
    hint = "transcript long, seq long, word_id string, kind string, scope string, value string"
    hints = spark.createDataFrame([(1, 2, "a", "user", "word", "x"), (1, 2, "a", "user", "segment", "x"), (1, 2, "b", "user", "speaker", "x"), (1, 3, "c", "user", "word", "x"), (1, 4, "c", "user", "word", "kept"), (1, 3, "b", "user", "word", "after"), (1, 1, "z", "user", "word", "x")], hint)
    got = {(r["word_id"], r["kind"], r["scope"], r["value"]) for r in D.folded_hints(df, hints).collect()}
    assert got == {("a", "user", "segment", "x"), ("b", "user", "speaker", "x"), ("b", "user", "word", "after"), ("c", "user", "word", "kept"), ("z", "user", "word", "x"), ("d", "provider_speaker_index", "word", "1")}
    assert D.folded_words(df.where("false")).count() == 0 and D.folded_hints(df.where("false"), hints).count() == 7
