"""Operators on small rows: edges that the driver's tables do not have."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from parley.functions import jsonx, text, times
from parley.functions.text import cologne
from parley.operators import graph, intervals, merge, relational, search, transcript, vectors, vocabulary
from parley.sources import meetings, sql
from parley.streaming import live_words as live


def rows(df, *names):
    return sorted((tuple(r[n] for n in (names or df.columns)) for r in df.collect()), key=repr)


def test_cologne_codes():
    expected = {"Müller": "657", "Wikipedia": "3412", "Breschnew": "17863", "Heinz": "068", "Philipp": "351", "Xaver": "4837", "Axt": "0482", "Scharfsinn": "87386", "": ""}
    assert {w: text.cologne(w) for w in expected} == expected


def test_components_spread_hubs(spark, monkeypatch):
    """With hubs found at any size, a star, a path and a clique give the same components."""
    pairs = [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(1, 9)] + [(a, b) for a in range(20, 26) for b in range(20, a)] + [(510, 3), (7, 7), (7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    plain = sorted(rows(graph.components(edges)))
    monkeypatch.setattr(graph, "HUB_EDGES", 0)
    monkeypatch.setattr(graph, "HUB_SHARE", 10)
    assert sorted(rows(graph.components(edges))) == plain
    assert {c for i, c in plain if i >= 500} == {1} and {c for i, c in plain if 20 <= i < 26} == {20}


def test_components_follow_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = dict(rows(graph.components(edges)))
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_disjunctive_join_keeps_a_pair_once(spark):
    a = spark.createDataFrame([(1, "x", "y"), (2, None, "y")], "l long, p string, q string")
    b = spark.createDataFrame([(10, "x", "y"), (11, "z", None)], "r long, s string, t string")
    assert rows(relational.disjunctive_join(a, b, [[("p", "s")], [("q", "t")]], "l", "r")) == [(1, 10), (2, 10)]


def test_anti_all_ignores_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    gone = spark.createDataFrame([(None,), (2,)], "x long")
    assert rows(relational.anti_all(a, "k", gone, gone)) == [(1,), (3,)]


def test_page_with_more_ends(spark):
    df = spark.range(25)
    last = relational.page_with_more(df, [F.col("id")], 20, 20).collect()
    assert [r["id"] for r in last] == [20, 21, 22, 23, 24] and not last[0]["has_more"] and last[0]["next_offset"] is None


def test_runs_count_the_latest_end(spark):
    df = spark.createDataFrame([("a", 0, 100), ("a", 10, 20), ("a", 90, 95), ("a", 130, 140), ("b", 0, 1)], "k string, s long, e long")
    assert rows(intervals.runs(df, ["k"], F.col("s"), F.col("e"), 10), "k", "start", "end", "n") == [("a", 0, 100, 3), ("a", 130, 140, 1), ("b", 0, 1, 1)]


def test_alone_subtracts_other_owners(spark):
    df = spark.createDataFrame([("c", 1, 0, 100), ("c", 2, 20, 30), ("c", 3, 25, 40), ("c", 2, 90, 120), ("d", 1, 5, 5)], "k string, o long, start long, end long")
    assert rows(intervals.alone(df, ["k"], "o")) == [("c", 1, 0, 20), ("c", 1, 40, 90), ("c", 2, 100, 120)]


def test_merges_leave_empty_tables_alone(spark):
    empty = spark.createDataFrame([], "id long, v string, deleted_at string")
    one = spark.createDataFrame([(1, "a", None)], "id long, v string, deleted_at string")
    assert rows(merge.upsert(empty, one, ["id"])) == [(1, "a", None)]
    assert rows(merge.upsert(one, empty, ["id"])) == [(1, "a", None)]
    assert rows(merge.tombstone(one, F.col("id") == 1, "t")) == [(1, "a", "t")]
    assert rows(merge.restore(merge.tombstone(one, F.col("id") == 1, "t"), "other")) == [(1, "a", "t")]


def test_ingest_outcomes_in_order(spark):
    e = [("m", 1, False, "a"), ("m", 1, False, "a"), ("m", 1, False, "b"), ("m", 0, False, "c"), ("x", 9, False, "a"), ("m", 2, True, "d"), ("m", 3, False, "e"), ("m", 2, True, "d")]
    df = spark.createDataFrame([("k", i, *x) for i, x in enumerate(e)], "k string, i long, source_id string, revision long, finalized boolean, content_hash string")
    got = [r["outcome"] for r in merge.ingest_outcomes(df, "k", ["i"]).orderBy("i").collect()]
    assert got == ["applied", "already", "conflict", "stale", "foreign", "applied", "final", "already"]


def test_json_guards(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("{bad",), (None,), ("[]",)], "j string")
    got = df.select(jsonx.field("j", "$.k", "long").alias("k"), jsonx.canonical("j").alias("c"), jsonx.with_field("j", "z", F.lit("1")).alias("w")).collect()
    assert [r["k"] for r in got] == [1, None, None, None]
    assert got[0]["c"] == '{"k":1}' and got[1]["c"] is None
    assert json.loads(got[0]["w"]) == {"k": "1", "z": "1"} and got[1]["w"] == "{bad"


def test_word_patches_are_bounded(spark):
    words = json.dumps([{"id": "1", "text": " helo"}, {"id": "2", "text": "x"}])
    good, bad = json.dumps([{"op": "replace", "path": "/0/text", "value": "hello"}]), json.dumps([{"op": "remove", "path": "/0"}])
    df = spark.createDataFrame([(words, good), (words, bad)], "w string, p string").select(jsonx.patched("w", "p").alias("o"))
    a, b = [r["o"] for r in df.collect()]
    assert json.loads(a)[0] == {"id": "1", "text": " hello", "state": "final"} and b is None


def test_clocks(spark):
    df = spark.createDataFrame([("01:02:03",), ("02:03",), ("x",), ("1:2:3:4",), ("",)], "t string")
    assert [r[0] for r in df.select(times.clock_ms("t")).collect()] == [3723000, 123000, 0, 0, 0]


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([], []), ([1.0, 0.0], [-2.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine("a", "b")).collect()] == [1.0, None, None, None, -1.0]


def test_mutual_best_needs_a_margin(spark):
    p = spark.createDataFrame([("s", "h", 0.9), ("s", "g", 0.85), ("t", "k", 0.9), ("t", "h", 0.5), ("u", "w", 0.5)], "speaker string, human string, score double")
    assert rows(vectors.mutual_best(p), "speaker", "human") == [("t", "k")]


def test_query_parts():
    assert search.parse('+Big "red fox" -cat "open end') == [("+", ["big"]), ("", ["red", "fox"]), ("-", ["cat"]), ("", ["open", "end"])]


def test_overlapping_hits(spark):
    df = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "ab"), (2, 1, "b")], "k long, o long, t string")
    assert rows(search.overlapping_hits(df, "k", "o", "t", "aa")) == [(1, 1, 3)]
    assert rows(search.overlapping_hits(df, "k", "o", "t", "a a")) == [(1, 1, 1)]


def test_swapped_letters_cost_one(spark):
    df = spark.createDataFrame([("idiot",), ("idito",), ("odiit",)], "w string")
    assert [r[0] for r in df.select(search.swapped_distance(F.col("w"), "idiot")).collect()] == [0, 1, 2]


def test_corrections_are_greedy_and_keep_punctuation(spark):
    docs = spark.createDataFrame([(1, "We met (new york), new yorker. New. York big apple pie!"), (2, ""), (3, "plain")], "id long, text string")
    aliases = spark.createDataFrame([("NYC", "new york"), ("Big Apple Pie", "big apple pie"), ("Wrong", "big apple"), ("A", "plain"), ("B", "plain")], "canonical string, alias string")
    got = {r["id"]: (r["text"], r["n"]) for r in vocabulary.corrected(docs, aliases).collect()}
    assert got[1] == ("We met (NYC), new yorker. New. York big apple pie!", 1)
    assert got[3] == ("plain", 0)


def test_inflections(spark):
    df = spark.createDataFrame([("Vertrag", "Vertrages"), ("Hausen", "Haus"), ("Meier", "Maier"), ("Marens", "Maren"), ("Grandpfeil", "Grandfall"), ("Lehrern", "Lehre")], "a string, b string")
    assert [r[0] for r in df.select(vocabulary.inflected("a", "b")).collect()] == [True, False, False, True, False, False]


def test_compounds_are_no_aliases(spark):
    pairs = spark.createDataFrame([("Kampagnen", "Kampagnenidee"), ("Sven", "Svenon"), ("Meier", "Maier")], "a string, b string")
    words = spark.createDataFrame([("idee",), ("on",)], "word string")
    assert rows(vocabulary._no_compounds(pairs, "a", "b", words)) == [("Meier", "Maier"), ("Sven", "Svenon")]


def test_scan_takes_a_pair_once_and_no_decided_one(spark):
    found = [(i, 1, w, c) for i, w, c in [(1, "Kowalski", None), (1, "Kowalsky", 0.5), (2, "Kowalsky", None), (2, "Kowalzki", 0.99), (3, "Schmidtke", None), (4, "Schmitdke", None)]]
    found = spark.createDataFrame(found, "id long, pos int, word string, confidence double")
    anchors = spark.createDataFrame([("Kowalski",), ("Schmidtke",)], "word string")
    names = anchors.selectExpr("cast(null as long) as id", "word", "2 as rank")
    dismissed = spark.createDataFrame([("schmidtke", "Schmitdke")], "canonical string, alias string")
    got = rows(vocabulary.scan(found, anchors, names, dismissed))
    assert got == [("Kowalski", "Kowalsky", 2, 2), ("Kowalski", "Kowalzki", 1, 1)]


def test_timed_words_keep_their_span(spark):
    """A pause, another speaker and another channel end a run; parts share the time by characters."""
    schema = "id long, channel int, speaker string, start_ms long, end_ms long, text string, confidence double"
    said = [(1, 0, "a", 0, 200, "Klick", 0.9), (1, 0, "a", 200, 400, "ab,", 0.4), (1, 0, "a", 2000, 2100, "Klick", 1.0), (1, 0, "a", 3200, 3300, "ab", 1.0), (1, 0, "a", 3300, 3400, "klick", None), (1, 0, "b", 3400, 3500, "ab", 1.0)]
    said += [(2, 0, None, 0, 90, "(nor", None), (2, 0, None, 90, 100, "druck).", 0.5)]
    aliases = spark.createDataFrame([("ClickUp", "klick ab"), ("NOR Drucktechnik", "nor druck")], "canonical string, alias string")
    got = rows(vocabulary.rewritten_words(spark.createDataFrame(said, schema), aliases), "id", "start_ms", "end_ms", "text", "confidence")
    kept = [(1, 2000, 2100, "Klick", 1.0), (1, 3200, 3300, "ab", 1.0), (1, 3300, 3400, "klick", None), (1, 3400, 3500, "ab", 1.0)]
    assert got == sorted([(1, 0, 400, "ClickUp,", 0.4), *kept, (2, 0, 22, "(NOR", None), (2, 22, 100, "Drucktechnik).", None)], key=repr)


def test_terms_are_folded(spark):
    df = spark.createDataFrame([("Café STRAẞE Łódź œuvre naïve Ωμέγα",)], "t string")
    assert df.select(text.word_tokens("t")).first()[0] == ["cafe", "strasse", "lodz", "oeuvre", "naive", "ωμέγα"]
    assert [text.folded_term(w) for w in ("Café", "Straße", "Łódź", "ŒUVRE")] == ["cafe", "strasse", "lodz", "oeuvre"]
    assert search.parse("+Über café") == [("+", ["uber"]), ("", ["cafe"])]
    docs = spark.createDataFrame([(1, "Im Café"), (2, "cafe"), (3, "tee")], "id long, content string")
    assert [r[0] for r in search.any_of(docs, ["cafe"]).orderBy("id").collect()] == [1, 2]


def test_keywords_by_kind(spark):
    body = "Die Katze schläft. Der Herr Wird kommt, Herr Wird geht! `code here` #plan_b ```more\ncode``` [Roter](x) Faden und Roter Faden"
    docs = spark.createDataFrame([(1, body, ["Anna", "x"]), (2, None, []), (3, "", None), (4, "anna Anna", ["ANNA"])], "id long, text string, named array<string>")
    got = search.keywords(docs, ("die", "der", "wird", "und")).orderBy("id", "place").collect()
    one = [(r["term"], r["n"]) for r in got if r["id"] == 1]
    assert one[:2] == [("Anna", 0), ("plan_b", 0)] and one[2:6] == [("Herr", 2), ("Wird", 2), ("Roter", 2), ("Faden", 2)]
    assert ("Katze schläft", 1) in one and ("Roter Faden", 1) in one and not {"code", "Die", "Der", "und", "x"} & {t for t, _ in one}
    assert [(r["term"], r["n"]) for r in got if r["id"] == 4] == [("ANNA", 0), ("anna Anna", 1)]
    assert {r["id"] for r in got} == {1, 4}


def test_alike_by_known_pairs(spark):
    """Two fifths of the letters and one code digit: pairs that are alike, and pairs that are not."""
    yes = [("Grandpfeil", "Grandfall"), ("Tofmann", "Tochmann"), ("Meierhofer", "Maiahover"), ("Verlin", "Ferlin"), ("Anna", "Enna")]
    no = [("Anna", "Ina"), ("Verlin", "verlin"), ("Grandpfeil", "Grandwehr")]
    df = spark.createDataFrame([(w, cologne(w)) for p in yes + no for w in p], "word string, code string").distinct()
    got = {(r["a"], r["b"]) for r in vocabulary.alike(df, F.lit("all")).collect()}
    pair = lambda p: tuple(sorted(p))
    assert {pair(p) for p in yes if cologne(p[0])} <= got and not got & {pair(p) for p in no}


def test_alike_loses_no_pair(spark):
    """Against all pairs of a block: short words, long words, and codes that differ in any digit or in length."""
    r = random.Random(7)
    base = ["Grandpfeil", "Tochmann", "Verlin", "Anna", "Thornton", "abcdefghijklmnopqrstuv", "abcdefghijklmnopqrstuvwxyzabcdefghijkl"]
    words = set(base)
    for w in base * 25:
        for _ in range(r.randint(1, max(1, len(w) * 2 // 5))):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abtknr") + w[i + 1 :], w[:i] + r.choice("abtknr") + w[i:]])
        words.add(w)
    df = spark.createDataFrame([(w, cologne(w)) for w in sorted(words)], "word string, code string").where("code <> ''")
    s = df.withColumn("block", F.substring("code", 1, 1))
    other = s.select(F.col("word").alias("w2"), F.col("code").alias("c2"), "block")
    near = (F.levenshtein(F.lower("word"), F.lower("w2")) <= F.floor(F.greatest(F.length("word"), F.length("w2")) * 0.4)) & (F.levenshtein("code", "c2") <= 1) & (F.lower("word") != F.lower("w2"))
    expected = {tuple(x) for x in s.join(other, "block").where("word < w2").where(near).select("word", "w2").collect()}
    got = vocabulary.alike(df, F.substring("code", 1, 1)).collect()
    assert len(got) == len(expected) > 100 and {tuple(x) for x in got} == expected


def test_ordinary_words_stand_in_lower_case(spark):
    docs = spark.createDataFrame([(1, "the Medien say. Medien and Verlin came"), (2, "our medien saw Verlin"), (3, "medien and the Verlin, verlin"), (4, "Only here")], "id long, text string")
    assert rows(vocabulary.ordinary_words(docs)) == [("and",), ("medien",), ("the",)]


def test_proposals_need_an_anchor(spark):
    """Second digits differ; the rarer spelling is canonical if it is the anchor; what is close only over others, known or immune stays out."""
    rows = [(i, "Tochmann") for i in range(3)] + [(1, "Tofmann"), (2, "Tochmann"), (3, "Verlin"), (4, "Ferlin"), (4, "Merkator"), (5, "Merkater"), (5, "Merkates"), (6, "Nortwind"), (6, "Nordwind")]
    found = spark.createDataFrame(rows, "id long, word string")
    names = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert cologne("Tochmann")[:2] != cologne("Tofmann")[:2]
    assert got(vocabulary.proposals(found, names("tofmann", "Nordwind"))) == [("Tofmann", "Tochmann", 4, 3)]
    assert got(vocabulary.proposals(found, names("Merkator"))) == [("Merkator", "Merkater", 1, 1), ("Merkator", "Merkates", 1, 1)]
    assert got(vocabulary.proposals(found, names("Merkator"), names("MERKATES"))) == [("Merkator", "Merkater", 1, 1)]
    chain = spark.createDataFrame([(1, "Landberger"), (2, "Lantberker"), (3, "Lantperkas")], "id long, word string")
    assert got(vocabulary.proposals(chain, names("Landberger"))) == [("Landberger", "Lantberker", 1, 1)]
    pairs = spark.createDataFrame([("merkator", "MERKATER ")], "canonical string, alias string")
    assert got(vocabulary.undecided(vocabulary.proposals(found, names("Merkator")), pairs)) == [("Merkator", "Merkates", 1, 1)]


def test_context_names_propose_in_both_orders(spark):
    """Names before and behind the word, confidence, immune words, names of another session, and the first name by rank."""
    rows = [(1, 1, "Ferlin", 0.5), (1, 2, "Verlim", None), (1, 3, "Werlin", 0.98), (1, 4, "Verlin", 0.1), (2, 1, "Tofmann", None), (3, 1, "Tofmann", None), (3, 2, "Zerlin", 0.2)]
    found = spark.createDataFrame(rows, "id long, pos int, word string, confidence double")
    names = spark.createDataFrame([(None, "Verlin", 1), (2, "Tochmann", 0), (2, "Tobmann", 1)], "id long, word string, rank int")
    got = sorted(tuple(r) for r in vocabulary.context_proposals(found, names).collect())
    assert got == [("Tochmann", "Tofmann", 1, 1), ("Verlin", "Ferlin", 1, 1), ("Verlin", "Verlim", 1, 1)]
    immune = spark.createDataFrame([("FERLIN",)], "word string")
    assert sorted(r["alias"] for r in vocabulary.context_proposals(found, names, immune).collect()) == ["Tofmann", "Verlim"]


def test_segments_cut_at_caps(spark):
    w = [(1, 0, None, None, i * 1000, i * 1000 + 900, f" w{i}") for i in range(400)] + [(1, 1, None, None, 500_000, 500_100, " x"), (1, 1, None, None, 503_200, 503_300, " y")]
    df = spark.createDataFrame(w, "transcript long, channel int, speaker_index int, human string, start_ms long, end_ms long, text string")
    got = rows(transcript.segments(df), "channel", "start_ms", "end_ms", "n")
    assert got == [(0, 0, 299_900, 300), (0, 300_000, 399_900, 100), (1, 500_000, 500_100, 1), (1, 503_200, 503_300, 1)]


def test_live_stream_equals_batch(spark, tmp_path):
    from parley.plans.catalogue.streams import messages

    m = messages(spark, "/root/testdata/sf0.001").select("transcript", "channel", F.col("seq").cast("long").alias("seq"), "kind", "job", "words")
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.live_words(spark.readStream.schema(live.MESSAGE).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    names = ("transcript", "channel", "id", "text", "state")
    assert rows(spark.table("live"), *names) == rows(live.batch_words(m), *names)


def test_live_step_rules():
    s = live.empty()
    w = lambda t, a, b: {"text": t, "start_ms": a, "end_ms": b}
    msg = lambda kind, *words, job=None: {"kind": kind, "job": job, "words": list(words)}
    assert live.step(s, msg("final", w(" Hel", 0, 100)), "k") == []
    assert [x["text"] for x in live.step(s, msg("final", w("lo", 150, 200), w(" you", 300, 400), job="j"), "k")] == [" Hello"]
    assert live.step(s, msg("final", w(" late", 300, 390)), "k") == []
    assert [x["text"] for x in live.step(s, msg("correction", w(" Hallo", 0, 200), job="j"), "k")] == [" Hallo"]
    assert live.step(s, msg("correction", w(" x", 0, 1), job="unknown"), "k") == []
    live.step(s, msg("partial", w(" more", 500, 600)), "k")
    assert [x["text"] for x in live.step(s, msg("flush"), "k")] == [" you", " more"]
    assert live.overlap_trimmed(["a", "b", "c"], ["B", "c", "d"]) == ["d"]
    assert live.collapsed(list("abcdefabcdef")) == list("abcdef")


def _said(kind, *words, job=None):
    return {"kind": kind, "job": job, "words": [{"text": t, "start_ms": a, "end_ms": b} for t, a, b in words]}


def _brief(words):
    return [(x["text"], x["state"], x["replaces"]) for x in words]


def test_live_partials_come_out_at_every_bound(monkeypatch):
    s = live.empty()
    assert live.step(s, _said("partial", (" a", 0, 10), (" b", 20, 30)), "k") == []
    assert _brief(live.step(s, _said("final", (" c", 40, 50)), "k")) == [(" a", "final", []), (" b", "final", [])]
    s = live.empty()
    many = [(f" w{i}", i * 10, i * 10 + 5) for i in range(live.MOST_PARTIALS + 3)]
    out = live.step(s, _said("partial", *many), "k")
    rest = live.step(s, _said("flush"), "k")
    assert out and [x["text"] for x in out + rest] == [w[0] for w in many]
    s = live.empty()
    live.step(s, _said("partial", (" old", 0, 10)), "k")
    live.step(s, _said("partial", (" new", live.LONGEST_PARTIALS + 10, live.LONGEST_PARTIALS + 20)), "k")
    assert s["held"]["text"] == " old" and s["watermark"] == 10
    monkeypatch.setattr(live, "MOST_PARTIAL_BYTES", 8)
    s = live.empty()
    out = live.step(s, _said("partial", *[(f" {c * 3}", i * 1000, i * 1000 + 5) for i, c in enumerate("abcd")]), "k")
    assert [x["text"] for x in out + live.step(s, _said("flush"), "k")] == [" aaa", " bbb", " ccc", " ddd"]


def test_live_jobs_are_promoted_not_lost():
    s = live.empty()
    out = []
    for i in range(live.MOST_JOBS + 2):  # the first job sends nothing, as its word is held
        out += live.step(s, _said("final", (f" w{i}", i * 1000, i * 1000 + 5), job=f"j{i}"), "k")
    assert _brief(w for w in out if w["state"] == "final") == [(" w0", "final", ["k:0:5"])] and len(s["jobs"]) == live.MOST_JOBS
    assert _brief(live.step(s, _said("correction", job="j2"), "k")) == [(" w1", "final", ["k:1000:1005"])]  # without words, the originals stand
    assert _brief(live.step(s, _said("correction", (" x", 2000, 2005), job="j3"), "k")) == [(" x", "final", ["k:2000:2005"])]
    again = live.step(s, _said("final", (" y", 90_000, 90_005), job="j4"), "k")  # a job's name taken again
    assert _brief(again) == [(f" w{live.MOST_JOBS + 1}", "pending", []), (" w3", "final", ["k:3000:3005"])]
    end = live.step(s, _said("flush"), "k")
    assert end[0]["text"] == " y" and {x["text"] for x in end[1:]} == {f" w{i}" for i in range(4, live.MOST_JOBS + 2)} and all(x["state"] == "final" for x in end)
    assert live.step(s, _said("flush"), "k") == []


def test_live_queries_run_once_a_commit(spark):
    from parley.streaming.live_query import LiveQueries

    live_queries, seen, value = LiveQueries(spark), [], [1]
    end = live_queries.subscribe("q", lambda: spark.range(value[0]), {"t"}, lambda df: seen.append(df.count()))
    assert live_queries.changed({"other"}, 1) == 0 and live_queries.changed({"t"}, 2) == 1
    value[0] = 3
    live_queries.changed({"t", "other"}, 3)
    live_queries.changed({"t"}, 3)  # seen already
    assert seen == [1, 3]
    end()
    assert live_queries.changed({"t"}, 4) == 0


def test_subtitle_files(spark):
    vtt = "WEBVTT\n\n1\n00:01.500 --> 00:00:03.000\n<v Ada>Hello <b>you</b>\n\nnote\n\n00:04.000 --> 00:05.000\nBob: hi: there"
    df = spark.createDataFrame([("f", vtt)], "path string, content string")
    assert rows(meetings.vtt_cues(df), "start_ms", "end_ms", "speaker", "text") == [(1500, 3000, "Ada", "Hello you"), (4000, 5000, "Bob", "hi: there")]


def test_checked_writes_leave_the_target_on_a_mismatch(spark, tmp_path):
    path = str(tmp_path / "t")
    assert meetings.write_checked(spark.range(3), path, 3) == 3
    with pytest.raises(ValueError):
        meetings.write_checked(spark.range(5), path, 4)
    assert spark.read.parquet(path).count() == 3
    # A run that stopped between its two moves: the table is put back; one that stopped after them: what it left goes.
    (tmp_path / "t").rename(tmp_path / "t__before")
    with pytest.raises(ValueError):
        meetings.write_checked(spark.range(5), path, 4)
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "t__before").exists()
    spark.range(9).write.parquet(str(tmp_path / "t__before"))
    assert meetings.write_checked(spark.range(2), path, 2) == 2 and sorted(x.name for x in tmp_path.iterdir()) == ["t"]


def test_read_only_catalog(spark, sf_dir):
    c = sql.Catalog(spark, sf_dir, ["nation"])
    assert c.execute_proxy("SELECT n_name FROM nation WHERE n_nationkey = ?", [3], "get") == ["NATION_3"]
    assert c.execute_proxy("SELECT n_name FROM nation WHERE n_nationkey = ?", [-3], "get") == []
    assert c.execute_proxy("SELECT 1", [], "run") == []
    with pytest.raises(ValueError):
        c.execute("DROP VIEW nation")
    assert sql.bound({"a": [1]}) == '{"a":[1]}'


def test_lists_keep_first_spellings(spark):
    df = spark.createDataFrame([([" New  York ", "b", "new york", "Zoo", "zoo", "apple"],), ([],), (["x"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(text.normalised_list("t")).collect()] == [["New York", "Zoo", "apple"], [], [], None]
    notes = spark.createDataFrame([("- One fact\n* one FACT\n2) Two\n\n3. Three\n4. Four",)], "t string")
    assert notes.select(text.key_facts("t")).first()[0] == ["One fact", "Two", "Three"]
