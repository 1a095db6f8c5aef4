"""Token ids in a byte-aligned binary format, with frequency-ranked values.

Ids are renumbered by how often they occur in the whole corpus, so frequent
ones are small, and written in two streams: control bytes, each with the byte
lengths of four values (2 bits each, length less one), and the values' bytes,
least first. A file is a Parquet table of blocks, so it is written and
committed by Spark's own writer and survives lost executors:

    blocks/      part, seq, first (ids of the part before the block), doc_ids, sizes, control, data
    vocabulary/  rank, id, n

Parts are ranges of doc_id in ascending order, nulls first, and sizes count the
end id that follows each document. Decoding is numpy table lookup: a control
byte gives four lengths, their running sum gives each value's place.

Texts are split at white space and each distinct word is encoded once by the
tokenizer, which gives the same ids as encoding the text for a tokenizer that
drops white space. Where its file says that it lower-cases and splits letters
from punctuation, words are folded to lower case and their last marks are words
of their own, so fewer words are encoded, and many at once.

Defined results: null text is empty and gets the end id alone; rows that repeat
a doc_id stay rows, in order of their texts' hashes; a very long text is encoded
whole; an empty table gives files without blocks; ids of equal frequency rank by
id; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import _text as X
from parley.llm._shared import Scratch

#: Ids of a block, about; ids of a part, about; words that a worker remembers at most.
BLOCK_IDS, PART_IDS, KNOWN_WORDS = 1 << 18, 8_000_000, 1_500_000
#: Words that are encoded as one text.
JOINED = 256

#: Bytes of the four values of each control byte, and their sum.
_LENGTHS = np.stack([(np.arange(256) >> (2 * i)) & 3 for i in range(4)], axis=1).astype(np.uint8) + 1


class _Words:
    """Ids of words by hash, for one tokenizer in one worker; entry 0 is the end id."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.folds = Tokenizer.from_file(path), end, folds(path)
        with open(path, encoding="utf-8") as f:
            suffix = (json.load(f).get("model") or {}).get("end_of_word_suffix")
        self.last = None
        if suffix and self.folds:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.hash, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.count, self.ids = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end], np.uint32)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(ids of each word, all ids, order): words encoded, in the order that is returned.

        Where the last id of a word shows that it is one, many words of letters
        are encoded as one text, and cut after those ids; if a text does not
        give as many words as it has, its words are encoded one by one.
        """
        joined = [i for i, w in enumerate(words) if w.isalpha()] if self.last is not None else []
        alone = [i for i, w in enumerate(words) if not w.isalpha()] if self.last is not None else list(range(len(words)))
        groups = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        counts, flat, order = [], [], []
        for group, x in zip(groups, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, np.uint32)
            cut = np.flatnonzero(self.last[ids])
            if len(cut) == len(group) and cut[-1] == len(ids) - 1:
                counts.append(np.diff(cut, prepend=-1))
                flat.append(ids)
                order += group
            else:
                alone += group
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)]
        counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(counts[-1].sum())))
        return np.concatenate(counts), np.concatenate(flat), order + alone

    def entries(self, t: X.Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each word."""
        h, first, back = np.unique(X.word_hashes(t, start, end), return_index=True, return_inverse=True)
        if len(self.count) > KNOWN_WORDS:
            self.clear()
        at = np.searchsorted(self.hash, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == h[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = t.data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            count, flat, order = self.encoded(words)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            entry = np.empty(len(new), np.int64)
            entry[order] = np.arange(len(self.count), len(self.count) + len(new))
            self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, flat])
            self.hash, self.index = np.insert(self.hash, at[new], h[new]), np.insert(self.index, at[new], entry)
            at = np.searchsorted(self.hash, h)
        return self.index[at][back] if len(h) else np.zeros(0, np.int64)


_KNOWN: dict[tuple[str, int], _Words] = {}

_MARKS = np.isin(np.arange(256), list(b".,;:!?"))
_ASCII_LETTERS = np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128)


def folds(path: str) -> bool:
    """Whether a tokenizer's file says that it lower-cases and that runs of letters are split from what follows."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    steps = lambda kind, inner: [x for x in [said.get(kind) or {}] for x in x.get(inner, [x])]
    splits = [x for x in steps("pre_tokenizer", "pretokenizers") if x.get("type") == "Split"]
    return any(x.get("type") == "Lowercase" for x in steps("normalizer", "normalizers")) and any("[\\p{L}]+" in x["pattern"].get("Regex", "") and x.get("invert") for x in splits)


def _folded(t: X.Texts, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> tuple[X.Texts, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in lower case, and words whose marks after a last ASCII letter are words of their own; words with '<' keep their case, as they may name special ids."""
    data = t.lowered().data
    odd = np.concatenate([[0], np.cumsum(t.data == ord("<"))])
    odd = np.flatnonzero(odd[stop] > odd[start])
    at = X.ranges(start[odd], (stop - start)[odd])
    data[at] = t.data[at]
    last = np.maximum.accumulate(np.where(_MARKS[data], -1, np.arange(len(data)))) if len(data) else np.zeros(0, np.int64)
    last = last[stop - 1] if len(stop) else last
    cut = (last >= start) & (last + 1 < stop) & _ASCII_LETTERS[data[np.maximum(last, 0)]] if len(stop) else np.zeros(0, bool)
    at = np.concatenate([[0], np.cumsum(1 + cut)])
    start, stop = np.repeat(start, 1 + cut), np.repeat(stop, 1 + cut)
    stop[at[:-1][cut]] = start[at[:-1][cut] + 1] = last[cut] + 1
    return X.Texts(data, t.bounds), start, stop, at[first]


def _tokenising(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _KNOWN.get((path, end)) or _KNOWN.setdefault((path, end), _Words(path, end))
        for batch in batches:
            for part in X.pieces(batch, "text"):
                t = X.texts_of(part.column("text"))
                start, stop, first = X.word_bounds(t)
                if words.folds:
                    t, start, stop, first = _folded(t, start, stop, first)
                entry = np.insert(words.entries(t, start, stop), first[1:], 0)
                count = words.count[entry]
                ids = words.ids[X.ranges(words.start[entry], count)]
                cut = np.concatenate([[0], np.cumsum(count)])[first + np.arange(len(first))]
                small = ids.astype("<u4" if len(ids) and ids.max() > 0xFFFF else "<u2")
                width = small.dtype.itemsize
                raw = small.tobytes()
                cuts = (cut * width).tolist()
                packed = pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(t), width, np.int32)), packed], ["doc_id", "width", "ids"])

    return run


def _unpacked(ids: pa.Array, width: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u4" if w == 4 else "<u2") for x, w in zip(ids, width.to_pylist(), strict=True)]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            n = np.bincount(np.concatenate(_unpacked(batch.column("ids"), batch.column("width"))))
            total, n = (total, n) if len(total) >= len(n) else (n, total)
            total[: len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned values below 2**32."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    four = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), four[np.arange(4)[None, :] < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of (control, data)."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)).astype(np.uint32)
    at = np.cumsum(size) - size
    out = raw[at]
    for i in range(1, 4):
        more = size > i
        if not more.any():
            break
        out[more] |= raw[at[more] + i] << np.uint32(8 * i)
    return out


_BLOCKS = "part int, seq int, first long, doc_ids array<long>, sizes array<long>, control binary, data binary"


def _blocks(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            control, data = pack(rank[np.concatenate(held)])
            cols = [[part], [seq], [before], [docs], [[len(x) for x in held]], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

        size = 0
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), _unpacked(batch.column("ids"), batch.column("width")), strict=True):
                docs.append(doc)
                held.append(ids)
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield block()
                    seq, before, docs, held, size = seq + 1, before + size, [], [], 0
        if held:
            yield block()

    return run


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Encodes documents (doc_id, text) and writes blocks/ and vocabulary/ under path, in ascending doc_id order."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenising(tokenizer, end), "doc_id long, width int, ids binary")
    ids = scratch.write(made, "ids")
    counts = ids.select("width", "ids").mapInArrow(_counting, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(((r["n"], r["id"]) for r in counts.collect()), key=lambda x: (-x[0], x[1]))  # as many as the tokenizer has ids
    rank = np.zeros(max((i for _, i in ranked), default=0) + 1, np.uint32)
    for k, (_, i) in enumerate(ranked):
        rank[i] = k
    spark.createDataFrame([(k, i, n) for k, (n, i) in enumerate(ranked)], "rank int, id long, n long").coalesce(1).write.parquet(f"{path}/vocabulary")
    parts = max(1, -(-sum(n for n, _ in ranked) // PART_IDS))
    dealt = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(_blocks(rank), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.delete()


def _read(spark: SparkSession, path: str, schema: str, one):
    """Rows of `one(doc_ids, start of each, ids of each)` for every block of the files, decoded."""
    vocabulary = spark.read.schema("rank int, id long, n long").parquet(f"{path}/vocabulary")
    back = np.zeros(vocabulary.count(), np.uint32)
    for r in vocabulary.select("rank", "id").collect():
        back[r["rank"]] = r["id"]
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    sums = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).collect()  # one row a part
    before, start = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        before[r["part"]] = start
        start += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, first, docs, sizes, control, data = (batch.column(c)[r] for c in ("part", "first", "doc_ids", "sizes", "control", "data"))
                size = np.array(sizes.as_py(), np.int64)
                ids = back[unpack(control.as_py(), data.as_py(), int(size.sum()))]
                cut = np.concatenate([[0], np.cumsum(size)])
                yield one(docs.values, before[part.as_py()] + first.as_py() + cut[:-1], [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])

    return blocks.mapInArrow(run, schema)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<long>) from the files."""

    def one(docs, start, ids) -> pa.RecordBatch:
        flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), pa.array(np.concatenate(ids).astype(np.int64)))
        return pa.RecordBatch.from_arrays([docs, pa.array(start), flat], ["doc_id", "start", "ids"])

    return _read(spark, path, "doc_id long, start long, ids array<long>", one)


def summarise_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: ids before the document, its ids, and their checksum."""

    def one(docs, start, ids) -> pa.RecordBatch:
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        return pa.RecordBatch.from_arrays([docs, pa.array(start), pa.array(list(map(len, ids)), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", one)
