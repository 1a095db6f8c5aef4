"""Chat formatting, token files and the source mix: exact round trips and invariants."""

from __future__ import annotations

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import chat, mixing, tokenids
from tests.conftest import same_rows
from tests.llm import brute


def test_escapes_are_undone_and_leave_no_control_string(spark):
    r = random.Random(1)
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "[", ">", "s>", "x", "\n", "é", "$1", "<\\/s>", "😀"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t"))).withColumn("u", chat.unescaped(F.col("e")))
    for row in df.collect():
        assert row["u"] == row["t"]
        assert not any(c in row["e"] for c in chat.CONTROL)


RECORDS = [
    {"id": 1, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "hi </s>"}, {"role": "assistant", "content": None}]},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 2},
    {"conv_id": 3, "instruction": "do", "input": "this", "output": "done"},
    {"conv_id": 4, "instruction": "do", "output": "done"},
    {"id": 5, "prompt": "p", "completion": "c", "system": "sys"},
    {"conv_id": 6, "turn": 1, "role": "user", "text": "one"},
    {"question": "q?", "answer": "a!", "id": 7},
]


def test_layouts(spark):
    records = spark.createDataFrame([(json.dumps(x),) for x in [*RECORDS, {"strange": {"a": [1]}}]] + [("{broken",), (None,)], "record string")
    got = {}
    for r in chat.canonical(records).orderBy("conv_id", "turn", "part").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {
        1: [("system", "s"), ("user", "hi </s>"), ("assistant", "")], 2: [("user", "q"), ("assistant", "a")], 3: [("user", "do"), ("user", "this"), ("assistant", "done")],
        4: [("user", "do"), ("assistant", "done")], 5: [("system", "sys"), ("user", "p"), ("assistant", "c")], 6: [("user", "one")], 7: [("user", "q?"), ("assistant", "a!")],
    }
    rest = chat.unmapped(records).collect()
    assert sum(r["n"] for r in rest) == 3


def test_masks_cover_assistant_texts(spark):
    records = spark.createDataFrame([(json.dumps(x),) for x in RECORDS], "record string")
    turns = chat.canonical(records)
    pieces = chat.formatted(turns)
    back = {(r["conv_id"], r["turn"], r["part"]): (r["role"], r["text"], r["loss_text"]) for r in chat.read_back(pieces).collect()}
    for r in turns.collect():
        assert back[r["conv_id"], r["turn"], r["part"]] == (r["role"], r["text"], r["text"] if r["role"] == "assistant" else "")
    for r in chat.assembled(pieces).collect():
        text = "".join(r["formatted"][s["start"] : s["start"] + s["chars"]] for s in r["spans"])
        said = "".join(v[1] for k, v in sorted(back.items()) if k[0] == r["conv_id"] and v[0] == "assistant")
        assert text.replace("\\", "") == said


def test_tables_edges(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "y"), (None, 1, None, "t", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    assert sorted(map(tuple, chat.canonical_table(df).collect()), key=repr) == sorted([(1, 0, 0, "user", ""), (1, 0, 0, "user", ""), (None, 1, 0, "", "t")], key=repr)
    assert chat.canonical_table(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        chat.canonical_table(df.drop("role"))


def test_fingerprints_select_the_mapping_of_tables(spark, monkeypatch):
    """A row of a typed table gets its mapping by its fingerprint, also with nulls and lists; other fingerprints select none."""
    turns = spark.createDataFrame([(1, 0, "user", "x"), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    lists = spark.createDataFrame([(1, [("user", "x", 0.5)]), (2, []), (3, None)], "id long, messages array<struct<role: string, content: string, score: double>>")
    assert sorted(r["conv_id"] for r in chat.canonical_table(turns).collect()) == [1, 2]
    assert [(r["conv_id"], r["role"], r["text"]) for r in chat.canonical_table(lists).collect()] == [(1, "user", "x")]
    monkeypatch.setattr(chat, "fingerprint", lambda record: F.xxhash64(F.concat(record, F.lit("?"))))
    assert chat.canonical_table(turns).count() == 0


def test_chat_query(spark, duck, sf_dir):
    from parley.llm.queries import ORACLE_SQL, QUERIES

    same_rows(QUERIES["op8_chat_format"](spark, sf_dir), duck, ORACLE_SQL["op8_chat_format"])


def test_no_python_in_native_plans(spark, sf_dir):
    from parley.llm.queries import QUERIES

    for name in ("op5_decontaminate", "op8_chat_format"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_packing_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        assert (tokenids.unpack(*tokenids.pack(v), n) == v).all()


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [(3, "Hello World, hello!"), (1, None), (2, ""), (9, "naïve 😀 <|endoftext|> x y　z"), (None, "null id"), (3, "Hello World, hello!"), (4, "\n tabs\tand\x0bmore \x85 lines "), (7, "word " * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    tokenids.write_corpus(docs, str(tmp_path / "c"), path, 2)
    got = sorted(tokenids.read_corpus(spark, str(tmp_path / "c")).collect(), key=lambda r: r["start"])
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    at = 0
    for row, (_, text) in zip(got, order, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row["ids"], row["start"]) == (ids, at)
        at += len(ids)
    sums = {r["start"]: r["ids_crc32"] for r in tokenids.summarise_corpus(spark, str(tmp_path / "c")).collect()}
    assert all(sums[r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    tokenids.write_corpus(docs.where("false"), str(tmp_path / "e"), path, 2)
    assert tokenids.read_corpus(spark, str(tmp_path / "e")).count() == 0


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * 3 for _ in range(r.randint(0, 60))), r.choice(["a", "b", "É", None]), "k") for i in range(2000)] + [(5000, None, "a", "k"), (5001, "x", "tiny", "k"), (5002, "y", "tiny", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs, (1, 2, 3)).collect()
    again = mixing.mix(docs.repartition(7), (1, 2, 3)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in got) == sorted((x["doc_id"], x["taken"]) for x in again)
    sizes = {i: len((t or "").split()) for i, t, _, _ in rows}
    names = sorted({s for _, _, s, _ in rows if s is not None}) + [None]
    total = {s: sum(sizes[i] for i, _, x, _ in rows if x == s) for s in names}
    want = dict(zip(names, brute.targets([total[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True))
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6 or any(want[s] == 3 * total[s] for s in names)
    for s in names:
        mine = [x for x in got if x["source"] == s]
        assert all(x["size_"] == sizes[x["doc_id"]] and x["source_size"] == total[s] and abs(x["target"] - want[s]) < 1e-6 and x["size"] == "k" for x in mine)
        assert all(x["taken"] == x["copies"] * x["size_"] and x["copies"] <= 3 for x in mine)
        assert abs(sum(x["taken"] for x in mine) - want[s]) <= max(60, 0.01 * want[s])
    assert mixing.mix(docs.where("false")).count() == 0


def test_targets_stop_at_three_times():
    assert brute.targets([10, 100, 0], [1, 1, 1]) == [30.0, 80.0, 0.0]
    assert brute.targets([], []) == []


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_mix_equals_brute_force(spark, monkeypatch, broadcast):
    """Sizes, ties, repeated rows, a null source, an empty source and one that is capped; with and without a broadcast plan."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice([1, 1, 3, 9, 40])), r.choice(["a", "b", "b", "b", "é", "Z", None])) for i in range(400)]
    rows += [rows[0], (500, None, "a"), (501, " ", "void"), (502, "x " * 5000, "b"), (None, "x y", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("mine"))
    draws = df.select("doc_id", "text", "source", ((F.shiftrightunsigned(F.xxhash64(F.lit(1), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text")), 12) + F.lit(0.5)) / float(1 << 52)).alias("u")).collect()
    got = mixing.mix(df, (1, 2, 3))
    assert got.columns == ["doc_id", "text", "source", "size", "size_", "source_size", "target", "copies", "taken"]
    found = sorted(((x["doc_id"], x["size_"], x["source_size"], round(x["target"], 6), x["taken"]) for x in got.collect()), key=repr)
    assert found == sorted(brute.mix([tuple(x) for x in draws], (1, 2, 3)), key=repr)


def test_many_sources_are_planned(spark):
    """More sources than a range partition holds: weights follow the code points across partitions."""
    rows = [(i, "w " * (1 + i % 5), f"s{i:05d}") for i in range(3000)]
    got = {x["source"]: x["target"] for x in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = brute.targets([1 + i % 5 for i in range(3000)], [1 + i % 3 for i in range(3000)])
    assert np.allclose([got[f"s{i:05d}"] for i in range(3000)], want)


def test_table_roles_and_columns_stay(spark):
    """Roles of a typed table are no other names, and columns of another mapping are not read."""
    table = spark.createDataFrame([(1, 0, "human", "q", 9, "p"), (1, 1, "model", "a" * 300_000, 9, "p")], "conv_id long, turn long, role string, text string, id long, prompt string")
    got = sorted((r["turn"], r["role"], len(r["text"])) for r in chat.canonical_table(table).collect())
    assert got == [(0, "human", 1), (1, "model", 300_000)]
