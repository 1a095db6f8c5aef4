"""How the sources of a language differ in their words, by sketch-prefiltered exact counts and sparse pair joins.

A term is a run of ASCII letters and bytes beyond ASCII, A-Z lowered. Every task
sketches the document frequencies of its (language, term) pairs: a count-min
sketch of two rows, in which a document adds one to a cell for each different
term that falls there, so that an estimate never lies below the frequency. The
sketches are added up in two levels, by block of cells, to a plane of bits of a
fixed most size: which cells reach `least`. The second pass drops all terms
whose cells do not, before anything is shuffled, and counts the rest exactly,
by their letters, in partial sums of each task. Frequencies decide then; the
sketch only saves shuffling and never decides that a term is kept.

Pairs are sparse: a pair of sources starts from what it would be if no term
occurred in either; then each source's terms are set against the other's rate
for absent terms, by classes of equal counts; only terms that both sources hold
are joined, and correct what the two classes assumed. All values are whole
numbers, so the sum is exact.

Defined results: null text, lang and source count as ''; rows that repeat a
document each count, also as documents; a very long text is a batch of its own,
whole; a language without kept terms gives pairs of value 0 and no terms; equal
values rank by the item's bytes; one source gives no pairs; an empty table gives
an empty one; other columns are not read. More than some 10**9 different terms
fill the sketch, which then drops fewer of them and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm import _text as X
from parley.llm._shared import checkpointed

#: Documents of the language that a kept term occurs in, and ranks of terms that are returned.
LEAST, TOP = 10, 10
#: Added to each count; parts that a whole distribution has.
PRIOR, PARTS = 2, 1_000_000_000
#: Rows of the sketch; cells of a row at most; bytes of text to a cell up to there; cells that are added up at once.
DEPTH, MOST_CELLS, BYTES_A_CELL, BLOCK = 2, 1 << 28, 32, 1 << 20
#: Bytes of text to a slice of the first level of adding; slices at most.
SLICE_BYTES, MOST_SLICES = 1 << 33, 256
#: Keys that a task holds before it gives out a sketch, and rows of counts before it gives them out.
HELD_KEYS, HELD_ROWS = 1_000_000, 100_000
#: Sources up to which they are broadcast to the classes of equal counts, a row of some hundred bytes each; beyond they are joined by a shuffle.
BROADCAST_SOURCES = 20_000
MOST_COUNT = (1 << 12) - 1

_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _terms(part: pa.RecordBatch) -> tuple[X.Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, start, end, doc, key): the terms of some documents, and 44 bits of each one's hash with its language."""
    t = X.texts_of(part.column("text")).lowered()
    start, end, first = X.word_bounds(t, _SEPARATORS)
    doc = np.repeat(np.arange(len(t), dtype=np.int64), np.diff(first))
    lang = X.texts_of(part.column("lang"))
    own = X.span_hashes(X._BYTE_CODE[lang.data], lang.bounds[:-1], lang.bounds[1:], salt=5)
    key = X.mix(X.word_hashes(t, start, end) ^ own[doc], 6) >> np.uint64(20)
    return t, start, end, doc, key


def _cells(key: np.ndarray, row: int, width: int) -> np.ndarray:
    return (X.mix(key, 90 + row) & np.uint64(width - 1)).astype(np.int64)


def _sketching(width: int, slices: int):
    """Rows (block, slice, payload): the cells that a task's documents count, by block, as offsets with counts in the low bits."""
    blocks = width // BLOCK

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, part = np.concatenate(held), TaskContext.get().partitionId() % slices
        for row in range(DEPTH):
            cell, count = np.unique(_cells(keys, row, width), return_counts=True)
            value = ((cell % BLOCK) * (MOST_COUNT + 1) + np.minimum(count, MOST_COUNT)).astype(np.uint32)
            block, at = np.unique(cell // BLOCK, return_index=True)
            cut = [*at.tolist(), len(cell)]
            payload = pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((block + row * blocks).astype(np.int32)), pa.array(np.full(len(block), part, np.int32)), payload], ["block", "slice", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in X.pieces(batch, "text"):
                _, _, _, doc, key = _terms(part)
                for a in range(0, part.num_rows, 1 << 20):  # the document's number stands above the key's 44 bits
                    mine = (doc >= a) & (doc < a + (1 << 20))
                    once = np.unique(((doc[mine] - a).astype(np.uint64) << np.uint64(44)) | key[mine])
                    held.append(once & np.uint64((1 << 44) - 1))
                    size += len(once)
                if size > HELD_KEYS:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _adding(least: int):
    """One slice of one block: how often each cell counts, up to `least`."""

    def run(rows: pa.Table) -> pa.Table:
        seen = np.zeros(BLOCK, dtype=np.uint16)
        for payload in rows.column("payload"):
            value = np.frombuffer(payload.as_py(), dtype=np.uint32)
            at = value // (MOST_COUNT + 1)
            seen[at] = np.minimum(seen[at] + value % (MOST_COUNT + 1), least)
        return pa.table({"block": rows.column("block")[:1], "sums": pa.array([seen.tobytes()], pa.binary())})

    return run


def _closing(least: int):
    """One block: packed bits of the cells that reach `least` over all slices."""

    def run(rows: pa.Table) -> pa.Table:
        seen = np.zeros(BLOCK, dtype=np.uint32)
        for sums in rows.column("sums"):
            seen += np.frombuffer(sums.as_py(), dtype=np.uint16)
        return pa.table({"block": rows.column("block")[:1], "bits": pa.array([np.packbits(seen >= least).tobytes()], pa.binary())})

    return run


def sketch(docs: DataFrame, least: int, width: int, slices: int) -> np.ndarray:
    """(DEPTH, width / 8): packed bits of the cells whose estimate reaches `least`; of a fixed size whatever the input."""
    enough = min(least, MOST_COUNT)
    parts = docs.mapInArrow(_sketching(width, slices), "block int, slice int, payload binary")
    sums = parts.groupBy("block", "slice").applyInArrow(_adding(enough), "block int, sums binary")
    planes = np.zeros((DEPTH, width // 8), dtype=np.uint8)
    for r in sums.groupBy("block").applyInArrow(_closing(enough), "block int, bits binary").toLocalIterator():
        row, block = divmod(r["block"], width // BLOCK)
        planes[row, block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return planes


def _strings(t: X.Texts, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes between bounds, as strings."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = t.data[X.ranges(start, size)]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


_COUNTS = "lang string, source string, term string, occurrences long, documents long"


def _counting(width: int, planes):
    """Exact partial counts of the terms that the sketch lets pass: occurrences, and documents with the term."""
    keys = ["lang", "source", "term"]

    def summed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_tables(held).group_by(keys).aggregate([("occurrences", "sum"), ("documents", "sum")])
        whole = whole.select([*keys, "occurrences_sum", "documents_sum"]).rename_columns([*keys, "occurrences", "documents"])
        yield from whole.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bits = [], 0, planes.value
        for batch in batches:
            for part in X.pieces(batch, "text"):
                t, start, end, doc, key = _terms(part)
                passes = np.ones(len(key), dtype=bool)
                for row in range(DEPTH):
                    cell = _cells(key, row, width)
                    passes &= (bits[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
                start, end, doc = start[passes], end[passes], doc[passes]
                if not len(start):
                    continue
                coded = _strings(t, start, end).dictionary_encode()
                kinds = len(coded.dictionary)
                pair, count = np.unique(doc * kinds + coded.indices.to_numpy().astype(np.int64), return_counts=True)
                lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                of = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                group, at = np.unique(of[pair // kinds] * kinds + pair % kinds, return_inverse=True)
                who, term = group // kinds, group % kinds
                held.append(pa.table({
                    "lang": lang.dictionary.take(pa.array(who // len(source.dictionary))).cast(pa.string()), "source": source.dictionary.take(pa.array(who % len(source.dictionary))).cast(pa.string()),
                    "term": coded.dictionary.take(pa.array(term)).cast(pa.string()), "occurrences": np.bincount(at, count, len(group)).astype(np.int64), "documents": np.bincount(at, minlength=len(group)),
                }))
                size += len(group)
                if size > HELD_ROWS:
                    done = list(summed(held))
                    held, size = [pa.Table.from_batches(done)], sum(b.num_rows for b in done)
                    if size > HELD_ROWS // 2:
                        yield from done
                        held, size = [], 0
        if held:
            yield from summed(held)

    return run


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, all_n): exact occurrences of every term that `least` documents of its language hold, in each source that has it and in the language."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MOST_CELLS, max(BLOCK, 1 << int(total // BYTES_A_CELL).bit_length()))
    planes = spark.sparkContext.broadcast(sketch(docs, least, width, min(MOST_SLICES, 1 + total // SLICE_BYTES)))
    partial = docs.mapInArrow(_counting(width, planes), _COUNTS)
    exact = checkpointed(partial.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("n"), F.sum("documents").alias("docs")))
    kept = exact.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least).drop("docs")
    return checkpointed(exact.drop("docs").join(kept, ["lang", "term"]))


def _rate(count: Column, total: str, kinds: str) -> Column:
    """1 + the whole part of PARTS * (count + PRIOR) / (total + PRIOR * kinds); decimals, as the product may pass 64 bits."""
    above = (count.cast("decimal(20,0)") + F.lit(PRIOR)) * F.lit(PARTS)
    return F.call_function("div", above.cast("decimal(38,0)"), (F.col(total) + PRIOR * F.col(kinds)).cast("decimal(38,0)")) + 1


def _apart(p: str, q: str) -> Column:
    """The whole part of (p - q)**2 / (p + q)."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pairs(known: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways."""
    a = sources.select("lang", F.col("source").alias("x"), F.col("held").alias("held_x"), F.col("absent").alias("absent_x"), "kinds")
    b = sources.select("lang", F.col("source").alias("y"), F.col("held").alias("held_y"), F.col("absent").alias("absent_y"))
    neither = a.join(b, "lang").where("x < y").select("lang", "x", "y", ((F.col("kinds") - F.col("held_x") - F.col("held_y")) * _apart("absent_x", "absent_y")).alias("value"))
    classes = known.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    others = F.broadcast(b) if sources.count() <= BROADCAST_SOURCES else b
    one = classes.join(others, "lang").where("source <> y").select("lang", F.least("source", "y").alias("x"), F.greatest("source", "y").alias("y"), (F.col("m") * _apart("p", "absent_y")).alias("value"))
    left = known.select("lang", "term", F.col("source").alias("x"), F.col("p").alias("p_x"), F.col("absent").alias("absent_x"))
    right = known.select("lang", "term", F.col("source").alias("y"), F.col("p").alias("p_y"), F.col("absent").alias("absent_y"))
    shared = _apart("p_x", "p_y") - _apart("p_x", "absent_y") - _apart("absent_x", "p_y") + _apart("absent_x", "absent_y")
    both = left.join(right, ["lang", "term"]).where("x < y").select("lang", "x", "y", shared.alias("value"))
    parts = [d.groupBy("lang", "x", "y").agg(F.sum("value").alias("value")) for d in (neither, one, both)]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    return total.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each source from every other of its language, and its `top` terms beyond the language's rate."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = counts(text, least)
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    whole = terms.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n").alias("all_total"))
    groups = text.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)
    absent = F.when(F.col("kinds") > 0, _rate(F.lit(0), "total", "kinds")).otherwise(F.lit(1))
    sources = checkpointed(groups.withColumn("absent", absent))
    known = terms.join(sources, ["lang", "source"]).select("lang", "source", "term", _rate(F.col("n"), "total", "kinds").alias("p"), _rate(F.col("all_n"), "all_total", "kinds").alias("q"), "absent")
    own = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    near = _pairs(known, sources).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(own).alias("rank"))
    over = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    return near.unionByName(over.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top))
