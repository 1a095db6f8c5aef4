"""Removal of passages that occur more than once, by a count-min prefilter and exact grouping.

A window is `size` consecutive words. Windows are sketched under their anchor:
of the k-word runs inside a window the one with the least hash, so that equal
windows have equal anchors and some thirteen neighbouring windows share one.
Every partition sketches its anchors, the sketches are summed into one of a
fixed most size, and its counts never fall below the number of starts of a
window. A second pass sends on only the windows whose estimate is two or more
and groups them exactly by a 96-bit fingerprint of their words; none that
repeats is lost, however full the sketch is.

Windows are dealt by anchor, so that neighbours stay together. Anchors that the
sketch estimates at HOT_PLACES places or more, as a phrase with different words
around it, are dealt by the windows' own fingerprints instead: equal windows
still meet, and no phrase gathers its windows in one task.

A task that sees a window twice marks its places at once and sends one row on
for it, so a passage of very many documents gives a row for each task.

Defined results: null text has no words and stays null; rows that repeat a
document repeat all its windows; texts shorter than a window are kept whole; a
very long text is a batch of its own, whole; an empty table gives an empty one.
Kept words are joined by single spaces where something was removed or not.
Columns named n_words or n_removed stay, and the new ones get an underscore.
Windows count as equal when 96 bits of their words' 64-bit hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import _text as X
from parley.llm._shared import checkpointed, row_key, unused

#: Words of a window.
SIZE = 50
#: Rows of the sketch.
DEPTH = 2
#: Cells of a row at most, and the words for which a row has one cell up to there.
MOST_CELLS, WORDS_A_CELL = 1 << 28, 2
#: Cells that one task sums up; bytes of text to a bucket of the exact grouping; words that are grouped in a task at once.
BLOCK_CELLS, BUCKET_BYTES, BATCH_WORDS = 1 << 20, 16_000_000, 2_000_000
#: Places from which an anchor's windows are spread; a task's count of a cell is carried up to MOST_COUNT, in the bits beside its offset.
HOT_PLACES, MOST_COUNT = 256, (1 << 12) - 1

_LOW = np.uint64(0xFFFFFFFF)


def _anchors(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor, hash): first word of every window, first word of its anchor, and the anchors' hashes by first word."""
    k = max(1, size * 2 // 7)
    runs, at = X.window_hashes(words, first, k, salt=31)
    keyed = np.full(len(words) + size, np.uint64(0xFFFFFFFFFFFFFFFF))
    full = np.zeros(len(words) + 1, dtype=np.uint64)
    full[at] = runs
    keyed[at] = (runs & ~_LOW) | at.astype(np.uint64)  # the leftmost of equal hashes
    low, have, want = keyed, 1, size - k + 1
    while have * 2 <= want:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if want > have:
        low = np.minimum(low[: len(low) - (want - have)], low[want - have :])
    start = X.ranges(first[:-1], np.maximum(np.diff(first) - size + 1, 0))
    return start, (low[start] & _LOW).astype(np.int64), full


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (X.mix(hashes, 60 + row) & np.uint64(width - 1)).astype(np.int64)


def _sketching(size: int, width: int):
    """Rows (block, payload): the cells of one task's anchors by block, as offsets with the task's counts in the low bits."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(held)
        for row in range(DEPTH):
            cell, count = np.unique(_cells(hashes, row, width), return_counts=True)
            value = ((cell % BLOCK_CELLS) * (MOST_COUNT + 1) + np.minimum(count, MOST_COUNT)).astype(np.uint32)
            block, at = np.unique(cell // BLOCK_CELLS, return_index=True)
            cut = [*at.tolist(), len(cell)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((block + row * (width // BLOCK_CELLS + 1)).astype(np.int32)), pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())],
                ["block", "payload"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in X.pieces(batch, "text"):
                t = X.texts_of(part.column("text"))
                start, end, first = X.word_bounds(t)
                _, anchor, full = _anchors(X.word_hashes(t, start, end), first, size)
                held.append(full[np.unique(anchor)])
            if sum(map(len, held)) > 4_000_000:
                yield from flush(held)
                held = []
        if sum(map(len, held)):
            yield from flush(held)

    return run


def _summing(hot: int):
    """The cells of one block that count two or more, as packed bits, and the offsets of those that count `hot` or more."""

    def run(block: pa.Table) -> pa.Table:
        seen = np.zeros(BLOCK_CELLS, dtype=np.uint32)
        for payload in block.column("payload"):
            value = np.frombuffer(payload.as_py(), dtype=np.uint32)
            at = value // (MOST_COUNT + 1)
            seen[at] = np.minimum(seen[at] + value % (MOST_COUNT + 1), max(hot, 2))
        often = np.flatnonzero(seen >= hot).astype(np.uint32)
        return pa.table({"block": block.column("block")[:1], "bits": pa.array([np.packbits(seen > 1).tobytes()], pa.binary()), "hot": pa.array([often.tobytes()], pa.binary())})

    return run


def _sketch(docs: DataFrame, size: int, width: int, hot: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of the sketch, packed bits of the cells that count two or more, of a fixed size whatever the input, and the few cells that count `hot` or more."""
    parts = docs.select("text").mapInArrow(_sketching(size, width), "block int, payload binary")
    sums = parts.groupBy("block").applyInArrow(_summing(hot), "block int, bits binary, hot binary")
    per_row, rows = width // BLOCK_CELLS + 1, [np.zeros(max(width, BLOCK_CELLS) // 8, dtype=np.uint8) for _ in range(DEPTH)]
    often: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
    for r in sums.toLocalIterator():
        at = (r["block"] % per_row) * (BLOCK_CELLS // 8)
        rows[r["block"] // per_row][at : at + BLOCK_CELLS // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
        often[r["block"] // per_row].append(np.frombuffer(r["hot"], dtype=np.uint32).astype(np.int64) + at * 8)
    return [(bits, np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *cells]))) for bits, cells in zip(rows, often, strict=True)]


_ENTRIES = "bucket int, h1 binary, h2 binary, multi binary, doc binary, pos binary, ids array<string>, texts array<long>"


def _sending(size: int, width: int, sketch, buckets: int):
    """Windows estimated to repeat, in rows by bucket. multi: 0 once in this batch, 1 the first of several here, 2 a place known to repeat."""
    names = [x.split()[0] for x in _ENTRIES.split(", ")]

    def flush(held: list[tuple], ids: list, keys: list) -> Iterator[pa.RecordBatch]:
        h1, h2, dealt, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, keys = np.concatenate(ids), np.concatenate(keys)
        order = np.lexsort((h2, h1))
        h1, h2, dealt, doc, pos = h1[order], h2[order], dealt[order], doc[order], pos[order]
        head = np.ones(len(h1) + 1, dtype=bool)
        head[1:-1] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        multi = np.where(head[:-1], (~head[1:]).astype(np.uint8), np.uint8(2))
        bucket = (dealt % np.uint64(buckets)).astype(np.int64)
        known = multi == 2
        bucket[known] = X.mix(keys[doc[known]].astype(np.uint64), 8) % np.uint64(buckets)
        order = np.lexsort((pos, doc, bucket))
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            at = order[cut[b] : cut[b + 1]]
            hashed = at[multi[at] < 2]
            own, index = np.unique(doc[at], return_inverse=True)
            cols = [h1[hashed], h2[hashed].astype(np.uint32), multi[at], index.astype(np.int32), pos[at].astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(b)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols), pa.array([ids[own].tolist()], pa.list_(pa.string())), pa.array([keys[own].tolist()], pa.list_(pa.int64()))], names
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, keys, docs, words_held = [], [], [], 0, 0
        planes = sketch.value
        for batch in batches:
            for part in X.pieces(batch, "text"):
                t = X.texts_of(part.column("text"))
                begin, end, first = X.word_bounds(t)
                words = X.word_hashes(t, begin, end)
                start, anchor, full = _anchors(words, first, size)
                if len(start):
                    places = np.unique(anchor)
                    often, hot = np.ones(len(places), dtype=bool), np.ones(len(places), dtype=bool)
                    for row, (plane, cells) in enumerate(planes):
                        cell = _cells(full[places], row, width)
                        often &= (plane[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
                        hot &= np.isin(cell, cells)
                    chosen, spread = np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=bool)
                    chosen[places[often]] = True
                    spread[places[hot]] = True
                    take = chosen[anchor]
                    start, anchor = start[take], anchor[take]
                if len(start):
                    doc = np.searchsorted(first, start, side="right") - 1
                    h1 = X.span_hashes(X.mix(words, 41), start, start + size, salt=42)
                    h2 = X.span_hashes(X.mix(words, 43), start, start + size, salt=44) & _LOW
                    dealt = np.where(spread[anchor], X.mix(h1, 9), full[anchor])
                    held.append((h1, h2, dealt, doc + docs, start - first[doc]))
                    ids.append(part.column("k_id").to_numpy(zero_copy_only=False))
                    keys.append(part.column("k_text").to_numpy())
                    docs, words_held = docs + part.num_rows, words_held + len(start)
                    if words_held > BATCH_WORDS:
                        yield from flush(held, ids, keys)
                        held, ids, keys, docs, words_held = [], [], [], 0, 0
        if held:
            yield from flush(held, ids, keys)

    return run


def _grouping(entries: pa.Table) -> pa.Table:
    """Places of the windows that repeat, by document, as runs (first start, starts)."""
    join = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in entries.column(name)])
    multi, doc, pos = join("multi", np.uint8), join("doc", np.int32).astype(np.int64), join("pos", np.int32).astype(np.int64)
    h1, h2 = join("h1", np.uint64), join("h2", np.uint32)
    doc += np.repeat(np.cumsum([0, *(len(x.as_py()) for x in entries.column("ids"))])[:-1], [len(x.as_py()) for x in entries.column("multi")])
    ids, keys = (entries.column(x).combine_chunks().flatten() for x in ("ids", "texts"))
    repeats = multi > 0
    hashed = np.flatnonzero(multi < 2)
    order = np.lexsort((h2, h1))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    group = np.cumsum(head) - 1
    votes = np.bincount(group, weights=1.0 + multi[hashed][order]) if len(order) else np.zeros(0)
    repeats[hashed[order[votes[group] > 1]]] = True
    doc, pos = doc[repeats], pos[repeats]
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    head = np.ones(len(doc), dtype=bool)
    head[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(head)
    runs = np.stack([pos[at], np.diff(np.append(at, len(doc)))], axis=1).astype(np.int32)
    own, first = np.unique(doc[at], return_index=True)
    cut = [*first.tolist(), len(at)]
    return pa.table({"k_id": ids.take(pa.array(own)), "k_text": keys.take(pa.array(own)), "runs": pa.array([runs[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})


def _cutting(size: int, text: str, runs: str, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch, text):
                t = X.texts_of(part.column(text))
                start, end, first = X.word_bounds(t)
                edge = np.zeros(len(start) + 1, dtype=np.int64)
                for i, lists in enumerate(part.column(runs)):
                    for x in lists.as_py() or ():
                        r = np.frombuffer(x, dtype=np.int32).reshape(-1, 2).astype(np.int64)
                        np.add.at(edge, first[i] + r[:, 0], 1)
                        np.add.at(edge, first[i] + r[:, 0] + r[:, 1] + size - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])
                s, e = start[keep], end[keep]
                data = np.append(t.data, np.uint8(32))
                source = X.ranges(s, e - s + 1)
                stop = np.cumsum(e - s + 1)
                if len(stop):
                    source[stop - 1] = len(t.data)  # the space after each word
                joined = data[source].tobytes()
                cut = np.concatenate([[0], stop])[kept[first]]
                texts = [joined[a : max(a, b - 1)].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                n = np.diff(first)
                new = [pa.array(texts, pa.string()), pa.array(n), pa.array(n - np.diff(kept[first]))]
                out = {c: part.column(c) for c in part.schema.names if c != runs}
                out[text] = pa.array([None if not v else x for v, x in zip(part.column(text).is_valid().to_pylist(), texts, strict=True)], pa.string())
                out |= dict(zip(added, new[1:], strict=True))
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Documents with every word covered by a repeated window cut from text; n_words and n_removed are added."""
    spark = docs.sparkSession
    keyed = docs.select("text", *row_key()) if "doc_id" in docs.columns else docs.select("text", F.lit("null").alias("k_id"), F.xxhash64("text").alias("k_text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MOST_CELLS, max(BLOCK_CELLS, 1 << int(total // (6 * WORDS_A_CELL)).bit_length()))
    buckets = max(64, int(total // BUCKET_BYTES))
    sketch = spark.sparkContext.broadcast(_sketch(keyed, size, width, HOT_PLACES))
    entries = keyed.where("text is not null").mapInArrow(_sending(size, width, sketch, buckets), _ENTRIES)
    places = entries.groupBy("bucket").applyInArrow(_grouping, "k_id string, k_text long, runs binary")
    marks = checkpointed(places.groupBy("k_id", "k_text").agg(F.collect_list("runs").alias("runs")))
    runs, added = unused(docs, "runs"), [unused(docs, "n_words"), unused(docs, "n_removed")]
    id_, hash_ = unused(docs, "k_id"), unused(docs, "k_text")
    key = row_key() if "doc_id" in docs.columns else [F.lit("null"), F.xxhash64("text")]
    marks = marks.select(F.col("k_id").alias(id_), F.col("k_text").alias(hash_), F.col("runs").alias(runs))
    joined = docs.withColumns({id_: key[0], hash_: key[1]}).join(marks, [id_, hash_], "left").select(*[F.col(f"`{c}`") for c in docs.columns], runs)
    schema = docs.withColumns({a: F.lit(0).cast("long") for a in added}).schema
    return joined.mapInArrow(_cutting(size, "text", runs, added), schema)
