"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

Equal vectors of a label are one node that counts for all of them. The nodes of
each label are assigned to cells of spherical k-means, which is fitted in a task
of the label on a sample of it; no centroid passes through the driver. A node
lives in its nearest cell and visits those cells that may hold a partner: of two
vectors at most an angle t apart that live on two sides of the border between
cells a and c, one is within t / 2 of that border, so x visits c only if x.a -
x.c <= sin(t / 2) * |a - c|. In a cell its inhabitants are multiplied out with
each other and with the visitors, in blocks of at most two times BLOCK nodes;
visitors are not compared with visitors. That loses no link, whatever the cells
are; labels of up to CELL nodes are one cell. Blocks give each node its number
of links and a spanning edge to the smallest node it is joined with there, never
the pairs.

Defined results: a null label, and vectors that are null, empty, zero or hold
null or non-finite components, link with nothing; vectors of different lengths
never link; a cosine equal to the threshold links; rows that repeat a vec_id are
vectors of their own, with the id in common; an empty table gives an empty one;
other columns, whatever their names, are not read. Vectors count as equal when
two 64-bit hashes of their components agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import _text as X
from parley.llm._shared import Scratch, checkpointed, components

THRESHOLD = 0.93
#: Nodes of a label for each of its cells; cells of a label at most (beyond that cells grow, with the same result); sampled rows a cell for the fit.
CELL, MOST_CELLS, SAMPLE_ROWS = 1024, 4096, 24
#: Nodes of a block from each of two sides; nodes that one task assigns; rounds of k-means.
BLOCK, DEALT, ROUNDS = 1024, 16_384, 6


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds unit, the vector in double precision divided by its length, and s1 and s2, hashes of its components; null for vectors that cannot link."""
    for batch in batches:
        lists, n = batch.column("embedding"), batch.num_rows
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        x = np.asarray(pc.fill_null(lists.flatten(), float("nan"))).astype(np.float64) + 0.0
        end = np.cumsum(size)
        start, full = end - size, size > 0
        row = np.repeat(np.arange(n), size)
        top = np.zeros(n)
        top[full] = np.maximum.reduceat(np.abs(x), start[full]) if full.any() else 0
        good = full & np.isfinite(top) & (top > 0) & np.asarray(batch.column("label").is_valid())
        y = np.where(good[row], x, 1.0) / np.where(good, top, 1.0)[row]  # keeps the squares finite
        length = np.ones(n)
        length[full] = np.sqrt(np.add.reduceat(y * y, start[full])) if full.any() else 1
        unit = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], end * 8]).astype(np.int32)), pa.py_buffer((y / length[row]).tobytes())])
        made = [pc.if_else(pa.array(good), c, pa.scalar(None, c.type)) for c in (unit, *(pa.array(X.span_hashes(x.view(np.uint64), start, end, salt=s).view(np.int64)) for s in (1, 2)))]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *made], ["vec_id", "label", "unit", "s1", "s2"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of spherical k-means over the rows of x, from evenly spaced first rows; products are taken in blocks of rows."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([(x[i : i + 1024] @ c.T).argmax(axis=1) for i in range(0, len(x), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(length > 0, total / np.maximum(length, 1e-300), c)
    return c


def _fitting(sample: pa.Table) -> pa.Table:
    """(kind, cell, centroid) of one label's sample."""
    sample = sample.take(pc.sort_indices(sample, [("s1", "ascending"), ("s2", "ascending")]))
    c = centroids(_matrix(sample.column("unit")), sample.column("k")[0].as_py())
    return pa.table({"kind": pa.array([sample.column("kind")[0].as_py()] * len(c), pa.string()), "cell": pa.array(np.arange(len(c), dtype=np.int32)), "centroid": pa.array([r.tobytes() for r in c], pa.binary())})


def _assigning(threshold: float):
    reach = np.sin(np.arccos(np.clip(threshold, -1, 1)) / 2) + 1e-9

    def run(nodes: pa.Table, cells: pa.Table) -> pa.Table:
        """Adds home, the nearest cell, and visits, the cells that may hold partners."""
        home, lists, counts = np.zeros(nodes.num_rows, np.int32), [], [np.zeros(1, np.int64)]
        if cells.num_rows:
            c = _matrix(cells.take(pc.sort_indices(cells, [("cell", "ascending")])).column("centroid"))
            apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
        for lo in range(0, nodes.num_rows, 1024):
            part = nodes.slice(lo, 1024)
            if not cells.num_rows:
                counts.append(np.zeros(part.num_rows, np.int64))
                continue
            near = _matrix(part.column("unit")) @ c.T
            own = near.argmax(axis=1)
            home[lo : lo + len(own)] = own
            to = near.max(axis=1, keepdims=True) - near <= reach * apart[own]
            to[np.arange(len(own)), own] = False
            lists.append(np.nonzero(to)[1])
            counts.append(to.sum(axis=1))
        visits = pa.ListArray.from_arrays(np.cumsum(np.concatenate(counts)).astype(np.int32), np.concatenate(lists or [np.zeros(0)]).astype(np.int32))
        return pa.table({**{n: nodes.column(n) for n in ("kind", "id", "s1", "m", "unit")}, "home": home, "visits": visits})

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n joins over pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _comparing(threshold: float):
    def run(block: pa.Table) -> pa.Table:
        """Links of one block: inhabitants of one part, of two parts (side 0 and 1), or inhabitants with visitors (side 2)."""
        block = block.take(pc.sort_indices(block, [("id", "ascending")]))
        ids, s1, m, side, home = (block.column(c).to_numpy() for c in ("id", "s1", "m", "side", "home"))
        u = _matrix(block.column("unit"))
        visits = block.column("visits").combine_chunks()
        wide = int(max(home.max(), np.asarray(visits.flatten()).max(initial=0))) + 1
        both_ways = np.repeat(np.arange(len(ids)), np.asarray(visits.value_lengths())) * wide + np.asarray(visits.flatten())
        one, other = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
        pairs = [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(one), 512):
            i, j = np.nonzero(u[one[lo : lo + 512]] @ u[other].T >= threshold)
            i, j = one[lo + i], other[j]
            keep = i < j if side.max() == 0 else i != j
            if side.max() == 2:  # found from both sides: counts for the visitor with the smaller hash
                keep &= (s1[j] < s1[i]) | ~np.isin(i * wide + home[j], both_ways)
            pairs.append(np.stack([i[keep], j[keep]]))
        i, j = np.concatenate(pairs, axis=1)
        links = np.bincount(i, weights=m[j], minlength=len(ids)) + np.bincount(j, weights=m[i], minlength=len(ids))
        at = np.flatnonzero(links)
        return pa.table({"id": ids[at], "s1": s1[at], "links": links[at].astype(np.int64), "root": ids[_roots(len(ids), i, j)][at]})

    return run


def _blocks(placed: DataFrame) -> DataFrame:
    """The blocks (kind, cell, p0, p1) of every cell, with their nodes and sides."""
    held = [F.col(c) for c in ("kind", "id", "s1", "m", "unit", "home", "visits")]
    living = placed.select(*held, F.col("home").alias("cell"))
    coming = placed.select(*held, F.explode("visits").alias("cell"))
    size = F.count("*").alias("n")
    parts = living.groupBy("kind", "cell").agg(size).select("kind", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("g"))
    guests = coming.groupBy("kind", "cell").agg(size).select("kind", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("v"))
    parts = parts.join(guests, ["kind", "cell"], "left").select("kind", "cell", "g", F.coalesce("v", F.lit(0)).alias("v"))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    living = living.join(parts, ["kind", "cell"]).withColumn("part", dealt("g"))
    inner = living.withColumn("other", F.explode(upto("g"))).withColumn("p0", F.least("part", "other")).withColumn("p1", F.greatest("part", "other")).withColumn("side", (F.col("part") != F.col("p0")).cast("int"))
    hosts = living.where("v > 0").withColumn("j", F.explode(upto("v"))).withColumn("p0", F.col("part")).withColumn("p1", -1 - F.col("j")).withColumn("side", F.lit(0))
    coming = coming.join(parts, ["kind", "cell"]).withColumn("p0", F.explode(upto("g"))).withColumn("p1", -1 - dealt("v")).withColumn("side", F.lit(2))
    names = ["cell", "p0", "p1", "side", "kind", "id", "s1", "m", "unit", "home", "visits"]
    return inner.select(*names).unionByName(hosts.select(*names)).unionByName(coming.select(*names))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label)."""
    with Scratch(vectors.sparkSession, "vectors") as scratch:
        return checkpointed(_near_vectors(vectors, scratch, threshold, cell))


def _near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float, cell: int) -> DataFrame:
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    made = typed.mapInArrow(_units, "vec_id long, label string, unit binary, s1 long, s2 long")
    rows = scratch.write(made.select("vec_id", F.concat_ws(":", F.length("unit"), "label").alias("kind"), "unit", "s1", "s2"), "rows")
    valid = rows.where("unit is not null and vec_id is not null")
    nodes = scratch.write(valid.groupBy("kind", "s1", "s2").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.any_value("unit").alias("unit")), "nodes")

    wanted = F.least(F.ceil(F.col("n") / cell), F.lit(MOST_CELLS)).cast("int")
    deal = F.pmod(F.xxhash64("s1"), F.lit(256)).cast("int").alias("deal")
    sizes = nodes.groupBy("kind", deal).agg(F.count("*").alias("n")).groupBy("kind").agg(F.sum("n").alias("n")).select("kind", "n", wanted.alias("k"), F.ceil(F.col("n") / DEALT).cast("int").alias("salts"))
    sized = scratch.write(sizes, "sizes")
    spread = sized.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(255))))  # each label's counts go to 256 parts of its nodes
    dealt = nodes.withColumn("deal", deal).join(spread, ["kind", "deal"])
    rate = F.least(F.lit(1.0), F.col("k") * SAMPLE_ROWS / F.col("n"))
    drawn = dealt.where("k > 1").where(F.pmod(F.xxhash64("s2"), F.lit(1 << 30)) < rate * (1 << 30)).select("kind", "k", "s1", "s2", "unit")
    cells = scratch.write(drawn.groupBy("kind").applyInArrow(_fitting, "kind string, cell int, centroid binary"), "cells")

    salted = dealt.select("kind", F.pmod(F.xxhash64("s1", "s2"), "salts").cast("int").alias("salt"), "id", "s1", "m", "unit")
    known = cells.join(sized, "kind").select("kind", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "cell", "centroid")
    placed = salted.groupBy("kind", "salt").cogroup(known.groupBy("kind", "salt")).applyInArrow(_assigning(threshold), "kind string, id long, s1 long, m long, unit binary, home int, visits array<int>")
    placed = scratch.write(placed, "placed")
    found = _blocks(placed).groupBy("kind", "cell", "p0", "p1").applyInArrow(_comparing(threshold), "id long, s1 long, links long, root long")
    found = scratch.write(found, "found")

    linked = found.groupBy("id", "s1").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = nodes.select("kind", "s1", "s2", "id", "m").join(linked, ["id", "s1"], "left").join(comp, "id", "left")
    known = known.select("kind", "s1", "s2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", "kind", "s1", "s2").join(known, ["kind", "s1", "s2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
