"""Session operators on small rows, against plain Python where there is a fold."""

from __future__ import annotations

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from parley.functions import jsonx
from parley.operators import sessions, transcript, vectors
from parley.sources import meetings


def folded(chunks, gap, least=200):
    out, wait = [], None
    for start, end, speech in sorted(chunks):
        if wait is None:
            if speech < least:
                wait = (start, end, speech, 1)
            else:
                out.append((start, end, speech, 1))
        elif max(start - wait[1], 0) <= gap:
            both = (wait[0], end, wait[2] + speech, wait[3] + 1)
            wait = both if both[2] < least else None
            if wait is None:
                out.append(both)
        else:
            out.append(wait)
            wait = (start, end, speech, 1)
    return out + ([wait] if wait else [])


@pytest.mark.parametrize(("redemption", "gap"), [(10, 100), (150, 150), (900, 250)])
def test_chunks_merge_as_in_a_fold(spark, redemption, gap):
    r = random.Random(redemption)
    chunks = {}
    for rec in range(6):
        at, rows = 0, []
        for _ in range(r.randint(1, 40)):
            at += r.choice([20, 90, 100, 150, 240, 250, 251, 900])
            n = r.choice([30, 90, 199, 200, 400])
            rows.append((at, at + n, n))
            at += n
        chunks[rec] = rows
    df = spark.createDataFrame([(k, *x) for k, v in chunks.items() for x in v], "recording long, start_ms long, end_ms long, speech_ms long")
    got = sorted(tuple(x) for x in sessions.merged_chunks(df, redemption).collect())
    assert got == sorted((k, *x) for k, v in chunks.items() for x in folded(v, gap))


BLOCK = "transcript long, channel int, speaker_index int, human string, start_ms long, end_ms long, last struct<start_ms:long,end_ms:long>, n long, text string"


def block(channel, speaker, human, start, end, n, text, last=None):
    return (1, channel, speaker, human, start, end, last or (end - 100, end), n, text)


def texts(df):
    return sorted((r["start_ms"], r["end_ms"], r["n"], r["text"]) for r in df.collect())


def test_propagation_joins_one_human_and_keeps_caps(spark, monkeypatch):
    rows = [
        block(0, 0, "h", 0, 900, 3, "a"), block(0, 1, "h", 1000, 1900, 3, "b"), block(1, 0, None, 1100, 1200, 1, "x"), block(0, 1, "h", 9000, 9100, 1, "c"), block(0, 2, "g", 9200, 9300, 1, "d"),
        block(0, 2, None, 9400, 9500, 1, "e"), block(0, 2, None, 9600, 9700, 1, "f"), block(2, None, None, 0, 100, 1, "p"), block(2, None, None, 200, 300, 1, "q"),
    ]
    df = spark.createDataFrame(rows, BLOCK)
    # Without speaker and human, p and q stay apart.
    want = [(0, 100, 1, "p"), (0, 1900, 6, "a b"), (200, 300, 1, "q"), (1100, 1200, 1, "x"), (9000, 9100, 1, "c"), (9200, 9300, 1, "d"), (9400, 9700, 2, "e f")]
    assert texts(transcript.propagated(df)) == want
    monkeypatch.setattr(transcript, "MOST_WORDS", 5)
    assert (0, 900, 3, "a") in texts(transcript.propagated(df)) and (1000, 1900, 3, "b") in texts(transcript.propagated(df))


def test_display_joins_by_identity_order_and_caps(spark):
    one = lambda *rows: texts(transcript.merged(spark.createDataFrame(list(rows), BLOCK)))
    a, b = block(0, 1, None, 0, 900, 500, "a"), block(0, 1, None, 2000, 2900, 500, "b")
    assert one(a, b) == [(0, 900, 500, "a"), (2000, 2900, 500, "b")]  # 1000 words
    assert one(a, block(0, 1, None, 2000, 2900, 12, "b")) == [(0, 2900, 512, "a b")]
    assert len(one(block(0, None, None, 0, 900, 1, "a"), block(0, None, None, 2000, 2900, 1, "b"))) == 2  # no identity
    assert len(one(block(0, 1, "h", 0, 900, 1, "a"), block(0, 2, "h", 2000, 2900, 1, "b"))) == 1
    assert len(one(block(0, 1, None, 0, 900, 1, "a"), block(1, 1, None, 1000, 1100, 1, "x"), block(0, 1, None, 2000, 2900, 1, "b"))) == 3  # another channel between
    assert len(one(block(0, 1, None, 0, 900, 1, "a"), block(0, 1, None, 40_901, 41_000, 1, "b"))) == 2
    assert len(one(block(0, 1, None, 0, 290_000, 1, "a"), block(0, 1, None, 290_100, 300_001, 1, "b"))) == 2  # five minutes
    assert len(one(block(0, 1, None, 0, 5000, 2, "a", (4900, 5000)), block(0, 1, None, 3000, 6000, 1, "b"))) == 2  # starts do not rise


def test_neutral_labels_spare_words_assigned_by_hand(spark):
    words = [(t, f"{t}w{i}", c, s) for t in (1, 2, 3, 4) for i, (c, s) in enumerate([(0, None), (0, None), (1 if t == 2 else 0, None)])]
    w = spark.createDataFrame(words, "transcript long, id string, channel int, speaker_index int")
    hints = spark.createDataFrame([(1, "word", "1w1", None, None, "h", True), (4, "speaker", None, 0, None, "h", True), (3, "channel", None, 0, None, "h", False)], "transcript long, scope string, word_id string, channel int, speaker_index int, human string, by_hand boolean")
    people = spark.createDataFrame([(1, "me"), (1, "you"), (2, "you"), (3, "me"), (3, ""), (4, "you")], "transcript long, human string")
    got = {r["id"] for r in transcript.neutral_words(w, hints, people, "me").where("neutral").collect()}
    assert got == {"1w0", "1w2"}  # 2 has two channels, 3 has no one else, 4 is assigned by hand


def test_flattening(spark):
    cases = [('[{"text":" a "},{"content":"b"},"c",5,["d"]]', "a b c d"), ('{"x":"[{\\"text\\":\\"in\\"}]","y":2}', "in"), ("plain", "plain"), ("[]", ""), ('{"text":"t"}', "t"), (None, None)]
    df = spark.createDataFrame(cases, "v string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", jsonx.flat_transcript("v")).collect())
    chats = [('{"sender":"s","text":" hi ","links":["u"]}', "s hi u"), ("not json", "not json"), ('{"type":"x"}', "")]
    assert all(r["got"] == r["want"] for r in spark.createDataFrame(chats, "v string, want string").withColumn("got", jsonx.flat_chat("v")).collect())
    apps = [('[{"app":"a","platform":"p"},3,{"name":"n"}]', "a p n"), ("{}", ""), ("bad", ""), (None, "")]
    assert all(r["got"] == r["want"] for r in spark.createDataFrame(apps, "v string, want string").withColumn("got", jsonx.flat_apps("v")).collect())


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 100])
def test_hmac(spark, key):
    texts = ["", "body", "é" * 200]
    got = [r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(meetings.hmac_sha256(key, F.col("t")).alias("h")).collect()]
    assert got == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_checked_write_keeps_the_table_on_a_wrong_count(spark, tmp_path):
    path = str(tmp_path / "t")
    assert meetings.write_checked(spark.range(3), path) == 3
    with pytest.raises(ValueError):
        meetings.write_checked(spark.range(5), path, 4)
    assert spark.read.parquet(path).count() == 3
    assert meetings.write_checked(spark.range(5), path, 5) == 5 and spark.read.parquet(path).count() == 5


def test_best_exemplars_in_several_lists(spark, monkeypatch):
    r = random.Random(3)
    v = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(20)] + [(99, [0.0] * 4)], "vec_id long, embedding array<double>")
    x = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(30)], "label int, centroid array<double>")
    one = sorted(map(tuple, vectors.best_of(v, x, 3).drop("embedding").collect()))
    monkeypatch.setattr(vectors, "MOST_EXEMPLARS", 7)
    assert one == sorted(map(tuple, vectors.best_of(v, x, 3).drop("embedding").collect())) and len(one) == 60


def test_promotion_and_creation(spark):
    c = spark.createDataFrame([(1, None), (2, "old"), (3, None)], "id long, deleted_at string")
    wanted = spark.createDataFrame([(1, 7, 0.5), (2, 7, 0.5), (3, 8, 0.5), (3, 7, 1.5), (9, 7, 1.0)], "id long, human long, confidence double")
    taken, after = sessions.promoted(c, wanted, spark.createDataFrame([(7,)], "human long"), F.lit("now"))
    assert [(r["id"], r["human"]) for r in taken.collect()] == [(1, 7)]
    assert {r["id"]: r["deleted_at"] for r in after.collect()} == {1: "now", 2: "old", 3: None}
    events = spark.createDataFrame([(1, "a"), (2, ""), (3, "b"), (4, "c")], "event long, external string")
    had = spark.createDataFrame([(1, ""), (8, "b")], "event long, external string")
    assert sorted(r["event"] for r in sessions.created_once(events, had).collect()) == [2, 4]


def test_peaks_merge_in_pairs(spark):
    """Against blocks that are merged in pairs while values come in, for lengths about powers of two."""
    import math

    from parley.operators import signal

    def outline(values, most):
        blocks, size, held = [], 1, []
        for v in values:
            held.append(abs(v) if math.isfinite(v) else 0.0)
            if len(held) == size:
                blocks, held = [*blocks, max(held)], []
                if len(blocks) >= 2 * most:
                    blocks, size = [max(blocks[i : i + 2]) for i in range(0, len(blocks), 2)], size * 2
        blocks += [max(held)] if held else []
        if len(blocks) <= most:
            return blocks
        step = len(blocks) / most
        return [max(blocks[math.floor(i * step) : min(math.ceil((i + 1) * step), len(blocks))]) for i in range(most)]

    series = {n: [((i * 7919) % 101 - 50) / 3 for i in range(n)] for n in (1, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40, 100)}
    series[3] = [float("nan"), -2.0, float("inf")]
    df = spark.createDataFrame([(n, i, v) for n, values in series.items() for i, v in enumerate(values)], "n long, i long, v double")
    got = {(r["n"], r["bucket"]): r["peak"] for r in signal.peaks(df, ["n"], "i", "v", 4).collect()}
    assert got == {(n, k): p for n, values in series.items() for k, p in enumerate(outline(values, 4))}


def test_speaker_spans_are_cut_and_long_enough(spark):
    from parley.operators import intervals

    words = [("a", 0, 0, 12_000), ("a", 0, 12_300, 20_000), ("a", 1, 19_000, 22_000), ("a", None, 30_000, 31_499), ("a", None, 40_000, 41_500), ("b", 1, 0, 5), *[("b", 2, i * 10_000, i * 10_000 + 2_000 + i) for i in range(5)], ("b", 3, 7, 7)]
    df = spark.createDataFrame(words, "channel string, speaker long, start_ms long, end_ms long")
    got = sorted((tuple(r) for r in intervals.speaker_spans(df, ["channel"], "speaker").collect()), key=repr)
    want = [("a", 0, 4_500, 14_500, 1, 1.0), ("a", 1, 20_000, 22_000, 1, 0.2), ("a", None, 40_000, 41_500, 1, 0.15), ("b", 2, 40_000, 42_004, 1, 0.2004), ("b", 2, 30_000, 32_003, 2, 0.2003), ("b", 2, 20_000, 22_002, 3, 0.2002)]
    assert got == sorted(want, key=repr)
