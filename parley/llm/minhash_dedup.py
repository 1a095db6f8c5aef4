"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles. The sketch fills `bands *
rows` coordinates by rounds of hashed bin placement: in round i below t an
element offers i + h to the bin that a hash picks, in round t + j it offers to
bin j alone, and rounds stop once every bin has a value, so each coordinate
fills and the estimate keeps its concentration bounds. Documents whose `rows`
coordinates agree in any band are candidates.

Candidates are never expanded into all pairs of a bucket. First each document
meets the smallest id of its buckets; then, in two rounds, documents outside the
largest linked group of a bucket meet drawn members of it, a few each. These
pairs are verified on the full sets. What is left in different groups of one
bucket is compared exactly, in blocks: members of a large group are sent once,
and the others of a bucket only to the blocks in which it has members. Groups
may be parts of a component, which costs comparisons but no link; components
are computed once, from all links. A pair of similarity s misses every band with
probability (1 - s**rows)**bands: 3e-6 at s = 0.8, 7e-9 at 0.85.

Shingles are compared by 64-bit hashes: a link is confirmed on the full sets of
these, and sets count as equal when their sizes and two 64-bit sums of mixed
hashes agree, so texts that share no shingle agree by chance in about one of
2**128 pairs.

Defined results: null or blank text has an empty set and links with nothing;
equal sets always link, ties at the threshold included; rows that repeat a
doc_id are one node, which links by any of its texts; rows with a null doc_id
are returned with a null component and kept; an empty table gives an empty one.
A very long text is a batch of its own, whole. Columns other than doc_id and
text, whatever their names, take no part; `deduplicate` returns them as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import _text as X
from parley.llm._shared import Scratch, checkpointed, components

BANDS, ROWS = 32, 5
#: Documents of a bucket or group that meet in one task, from each of two parts.
BLOCK = 1024
#: Rounds in which documents meet drawn members of their buckets' largest groups, and how many each round.
ROUNDS, HUBS = 1, 6
#: Parts into which a group of any size is dealt when its documents are counted or joined.
SALTS = 64


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, cut): sorted distinct 64-bit shingles of text i are elements[cut[i]:cut[i+1]]."""
    t = X.texts_of(column).lowered()
    start, end, first = X.word_bounds(t)
    words = X.word_hashes(t, start, end)
    count = np.diff(first)
    h, at = X.window_hashes(words, first, shingle)
    doc = np.repeat(np.arange(len(t)), np.maximum(count - shingle + 1, 0))
    for n in range(1, shingle):  # fewer words than a shingle: the whole sequence is the one element
        short = np.flatnonzero(count == n)
        if len(short):
            h = np.concatenate([h, X.span_hashes(X.mix(words, 9), first[:-1][short], first[1:][short], salt=100 + n)])
            doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(t) + 1))


def sketches(h: np.ndarray, cut: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates for each non-empty set, zeros for an empty one."""
    n = len(cut) - 1
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, t), top)
    doc = np.repeat(np.arange(n), np.diff(cut))
    open_ = np.diff(cut) > 0
    flat = out.reshape(-1)
    for i in range(2 * t):
        live = open_[doc]
        if not live.any():
            break
        e, d = h[live], doc[live]
        v = X.mix(e, 1000 + i)
        bins = (X.mix(e, 5000 + i) % np.uint64(t)).astype(np.int64) if i < t else np.full(len(e), i - t)
        value = (np.uint64(i) << np.uint64(52)) | (v >> np.uint64(12))  # ordered by round first, as i + h
        np.minimum.at(flat, d * t + bins, value)
        open_ &= (out == top).any(axis=1)
    out[out == top] = 0
    return out


def _sketch_batches(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch, "text"):
                h, cut = shingle_sets(part.column("text"), shingle)
                n = np.diff(cut)
                keys = X.span_hashes(sketches(h, cut, bands * rows).reshape(-1), np.arange(len(n) * bands) * rows, np.arange(1, len(n) * bands + 1) * rows)
                keys = X.mix(keys ^ X.mix(np.tile(np.arange(bands, dtype=np.uint64), len(n)), 3), 4).view(np.int64)
                sums = []
                with np.errstate(over="ignore"):
                    for salt in (21, 22):
                        total = np.zeros(len(h) + 1, dtype=np.uint64)
                        np.cumsum(X.mix(h, salt), out=total[1:])
                        sums.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
                lists = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, bands, dtype=np.int32), keys)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n", "h1", "h2", "bands"])

    return run


def _matching(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch, "text_a", X.CHUNK_BYTES // 2):
                n = part.num_rows
                a, ca = shingle_sets(part.column("text_a"), shingle)
                b, cb = shingle_sets(part.column("text_b"), shingle)
                row = np.concatenate([np.repeat(np.arange(n), np.diff(ca)), np.repeat(np.arange(n), np.diff(cb))])
                both = np.concatenate([a, b])
                order = np.lexsort((both, row))
                both, row = both[order], row[order]
                same = row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])]
                inter = np.bincount(same, minlength=n)
                union = np.diff(ca) + np.diff(cb) - inter
                keep = (100 * inter >= percent * union) & (union > 0)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _cross_links(shingle: int, percent: int):
    """Links between different components c among the documents of one block, by blocked products of their incidence matrix."""

    def run(block: pa.Table) -> pa.Table:
        ids, c, part = (block.column(x).to_numpy() for x in ("id", "c", "part"))
        h, cut = shingle_sets(block.column("text"), shingle)
        size, doc = np.diff(cut), np.repeat(np.arange(len(ids)), np.diff(cut))
        _, element, often = np.unique(h, return_inverse=True, return_counts=True)
        shared = often[element] > 1
        order = np.argsort(element[shared], kind="stable")
        doc = doc[shared][order]
        column = np.unique(element[shared][order], return_inverse=True)[1]
        values, counts = np.unique(c, return_counts=True)
        odd = np.flatnonzero(c != values[counts.argmax()])  # pairs within one component need no look
        found = []
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 2048, 2048)).tolist()
        for x in (odd[i : i + 512] for i in range(0, len(odd), 512)):
            inter = np.zeros((len(x), len(ids)), dtype=np.float32)
            for lo, hi in zip(edges, edges[1:], strict=False):
                m = np.zeros((len(ids), 2048), dtype=np.float32)
                m[doc[lo:hi], column[lo:hi] % 2048] = 1
                inter += m[x] @ m.T
            inter = inter.astype(np.int64)
            union = size[x][:, None] + size[None, :] - inter
            good = (100 * inter >= percent * union) & (c[x][:, None] != c[None, :])
            if block.column("p0")[0] != block.column("p1")[0]:
                good &= part[x][:, None] != part[None, :]
            i, j = np.nonzero(good)
            found.append(np.stack([ids[x[i]], ids[j]]))
        pair = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        pair = np.unique(np.sort(pair, axis=0), axis=1)
        return pa.table({"a": pair[0], "b": pair[1]})

    return run


def _cross(held: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """Links between members (key, id, c) of one bucket that are in different groups c, all of them found.

    Groups of up to BLOCK documents meet inside each bucket. A larger one is
    dealt into blocks by id; its documents are sent there, and from every bucket
    the members of smaller groups go to those blocks that have members in
    the bucket. Incoming documents are dealt into parts as well, so no task gets
    more than two times BLOCK documents.
    """
    mixed = held.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    held = scratch.write(held.join(mixed, "key"), "held")

    # Sizes matter for groups above BLOCK alone: these are few, and go to each salt of their documents, so that no group is one task's.
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    sizes = held.select("id", "c").distinct().groupBy("c", salt.alias("salt")).agg(F.count("*").alias("n")).groupBy("c").agg(F.sum("n").alias("n_c"))
    sizes = sizes.where(F.col("n_c") > BLOCK).select("c", "n_c", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = held.withColumn("salt", salt).join(sizes, ["c", "salt"], "left").select("key", "id", "c", "n_c")
    held = scratch.write(held, "sized")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / BLOCK)).cast("int")

    small = held.where("n_c is null")
    still = small.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).where("c0 <> c1").select("key", "m")
    small = small.join(still, "key").withColumn("part", dealt("m")).withColumn("other", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / BLOCK).cast("int") - 1)))
    small = small.select("key", F.least("part", "other").alias("p0"), F.greatest("part", "other").alias("p1"), "part", "id", "c")

    large = held.where("n_c is not null").withColumn("part", dealt("n_c"))
    blocks = large.select("key", F.col("c").alias("c_b"), F.col("n_c").alias("n_b"), "part").distinct()
    size = F.coalesce("n_c", F.lit(0))
    coming = held.join(blocks, "key").where((size < F.col("n_b")) | ((size == F.col("n_b")) & (F.col("c") < F.col("c_b"))))
    coming = scratch.write(coming.select("c_b", "part", "id", "c").distinct(), "coming")
    parts = coming.groupBy("c_b", "part").agg(F.count("*").alias("n_in"))
    coming = coming.join(parts, ["c_b", "part"]).select("c_b", "part", dealt("n_in").alias("j"), F.lit(1).alias("side"), "id", "c")
    own = large.select(F.col("c").alias("c_b"), "part", "id", "c").distinct().join(parts, ["c_b", "part"])
    own = own.select("c_b", "part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_in") / BLOCK).cast("int") - 1)).alias("j"), F.lit(0).alias("side"), "id", "c")
    wide = own.unionByName(coming).select(F.col("c_b").alias("key"), F.col("part").alias("p0"), (-1 - F.col("j")).alias("p1"), F.col("side").alias("part"), "id", "c")

    met = scratch.write(small.unionByName(wide), "met")
    return met.join(texts, "id").groupBy("key", "p0", "p1").applyInArrow(_cross_links(shingle, percent), "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough, by the texts (id, text)."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_matching(shingle, percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text)."""
    with Scratch(docs.sparkSession, "minhash") as scratch:
        return checkpointed(_near_duplicates(docs, scratch, shingle, percent, bands, rows))


def _near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = docs.mapInArrow(_sketch_batches(shingle, bands, rows), "doc_id long, n long, h1 long, h2 long, bands array<long>")
    sketch = scratch.write(made, "sketch")

    # Equal sets are one class, so that a group of copies is one node from here on; they have equal bands.
    members = sketch.where("doc_id is not null and n > 0")
    classes = members.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    band = classes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("key"))
    # Buckets with the same members (a pair of copies shares most of its bands) are looked at once; the hashes tell sets of ids apart.
    stats = band.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("m"), *(F.sum(F.shiftright(F.xxhash64("id", F.lit(s)), 20)).alias(f"s{s}") for s in (1, 2))).where("a <> z")
    stats = stats.groupBy("a", "z", "m", "s1", "s2").agg(F.min("key").alias("key"))
    bucket = scratch.write(band.join(stats.select("key", "a"), "key").select("key", "a", "id", "n"), "bucket")
    # Merge joins at every size: ids and pairs grow with the documents, so a plan that sends them to all tasks would be one for small inputs alone.
    texts = scratch.write(docs.withColumnRenamed("doc_id", "id").join(bucket.select("id").distinct().hint("merge"), "id", "left_semi"), "texts")

    def near(other: str) -> Column:
        """Whether sizes allow a link."""
        return F.greatest("n", other) * percent <= F.least("n", other) * 100

    sizes = bucket.where("id = a").select("a", F.col("n").alias("n_a")).distinct()
    spokes = bucket.where("id <> a").select("a", "id", "n").join(sizes, "a").where(near("n_a"))
    one = spokes.groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    links = scratch.write(_verified(one, texts, shingle, percent), "spokes")

    # Groups so far: documents of one group are linked by a path, but a component may still be several groups.
    above = links.select(F.col("b").alias("a"), F.col("a").alias("top"))  # each b has one a
    group = scratch.write(links.join(above, "a", "left").select(F.col("b").alias("id"), F.coalesce("top", "a").alias("c")), "group")
    links = group.select(F.col("c").alias("a"), F.col("id").alias("b"))  # the same components, and shorter paths

    def held_by(group: DataFrame) -> DataFrame:
        """Buckets with the group c of each member so far, a member's own id where it has no link."""
        return bucket.join(group, "id", "left").select("key", "id", "n", F.coalesce("c", "id").alias("c"))

    for round_ in range(ROUNDS):
        held = scratch.write(held_by(group), f"held{round_}")
        groups = held.groupBy("key", "c").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("id", "key", F.lit(round_)).alias("r"), "id", "n")).alias("hub"))
        top = groups.groupBy("key").agg(F.max(F.struct("m", "c", "hub")).alias("t"), F.count("*").alias("k")).where("k > 1")
        top = top.select("key", F.col("t.c").alias("c_t"), F.col("t.hub.id").alias("hub"), F.col("t.hub.n").alias("n_t"))
        tried = held.join(top, "key").where((F.col("c") != F.col("c_t")) & near("n_t")).select("id", "c", "hub", "c_t").distinct()
        few = tried.groupBy("id", "c").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("id", "hub").alias("r"), "hub", "c_t"))), 1, HUBS).alias("h"))  # a document has at most `bands` hubs
        pairs = few.select(F.col("id").alias("a"), "c", F.explode("h").alias("h")).select("a", F.col("h.hub").alias("b"), "c", F.col("h.c_t").alias("c_b"))
        pairs = scratch.write(pairs, f"pairs{round_}")
        found = scratch.write(_verified(pairs, texts, shingle, percent), f"found{round_}")
        links = links.unionByName(found)
        moved = found.join(pairs, ["a", "b"]).groupBy(F.col("a").alias("id")).agg(F.min("c_b").alias("to"))
        group = group.join(moved, "id", "full_outer").select("id", F.coalesce("to", "c").alias("c"))

    crossed = scratch.write(_cross(held_by(group).select("key", "id", "c"), texts, scratch, shingle, percent), "crossed")
    # Only classes of several rows matter here; they go to each salt of their members, so that no group of copies is one task's.
    several = classes.where("copies > 1").select("h1", "h2", "n", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of = members.select("doc_id", "h1", "h2", "n", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(several, ["h1", "h2", "n", "salt"])
    same = of.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    comp = components(links.unionByName(crossed).unionByName(same))

    out = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but one, the smallest id, of each group of near duplicates; all columns as they were."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
