"""Language identification by prediction by partial matching over bytes.

Every language has a context tree of up to ORDER bytes, held as counts of byte
runs. A byte that has not followed its context costs an escape, `kinds` out of
`total + kinds`, and is coded again in the context one byte shorter, down to a
uniform code over 256 bytes, which bytes that no language has seen take as well.
After training the counts are frozen, so the exact code length of a byte depends on its context alone and whole texts are scored
by table lookups; the answer is the language with the shortest code.

Defined results: null text and text without a letter give `und` with score 0;
languages without labelled rows are not learned; without any labelled row every
text gives `und`; of languages with equal code lengths the first by name is
taken; a very long text is coded whole; repeated rows are each answered; an
empty table gives an empty one. Columns named lang_pred, score or bits_per_byte
stay, and the new ones get an underscore. Labels are read in training only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import _text as X
from parley.llm._shared import give_back, unused

#: Bytes of context at most.
ORDER = 3
#: Labelled rows that training reads for each language, about, drawn by a hash of the row.
SAMPLE_ROWS = 400
#: A text is rejected when even its best language needs more bits a byte than this.
MAX_BITS = 7.0


#: Bits of a byte in the key of a run; 0 stands before a text, each byte for itself plus one.
WIDE = 9


@dataclass
class Table:
    """Code lengths of runs of bytes that some language has seen, and what escaping from their contexts costs; a column for each language."""

    slots: np.ndarray
    cost: np.ndarray
    homes: np.ndarray
    skip: np.ndarray


@dataclass
class Model:
    """Code lengths in bits, a column for each language: `pairs` of a byte by the one before it, `tables` by two and by three before it."""

    langs: list[str]
    pairs: np.ndarray
    tables: list[Table]


def _runs(t: X.Texts) -> list[np.ndarray]:
    """For each byte the keys of the runs of 1 to ORDER + 1 bytes that end in it."""
    c = t.data.astype(np.uint64) + np.uint64(1)
    out, heads = [c], t.bounds[:-1]
    for k in range(1, ORDER + 1):
        part = np.zeros(len(c), np.uint64)
        part[k:] = c[: len(c) - k]
        for i in range(k):
            at = heads + i
            part[at[at < len(c)]] = 0
        out.append(out[-1] | (part << np.uint64(WIDE * k)))
    return out


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _stored(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open-addressing table: each key plus one at its slot (0 is free), and the rows beside."""
    size = 1 << int(2 * len(keys) + 16).bit_length()
    slots, beside = np.zeros(size, np.uint64), np.zeros((size, rows.shape[1]), np.float32)
    at, left = _slot(keys, size), np.arange(len(keys))
    while len(left):
        here, first = np.unique(at[left], return_index=True)
        first = first[slots[here] == 0]
        slots[at[left[first]]] = keys[left[first]] + np.uint64(1)
        beside[at[left[first]]] = rows[left[first]]
        left = np.delete(left, first)
        at[left] = (at[left] + 1) % size
    return slots, beside


def _found(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where it is not stored."""
    at = _slot(keys, len(slots))
    tag = keys + np.uint64(1)
    got = slots[at]
    out = np.where(got == tag, at, -1)
    open_ = np.flatnonzero((got != tag) & (got != 0))
    while len(open_):
        at[open_] = (at[open_] + 1) % len(slots)
        got = slots[at[open_]]
        hit = got == tag[open_]
        out[open_[hit]] = at[open_[hit]]
        open_ = open_[~hit & (got != 0)]
    return out


def _contexts(run: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, skip, own): the contexts of sorted runs, what escaping from each costs, and what each run costs in its own."""
    ctx, at, kinds = np.unique(run >> np.uint64(WIDE), return_index=True, return_counts=True)
    total = np.add.reduceat(count, at) if len(at) else kinds
    return ctx, np.log2((total + kinds) / kinds), np.repeat(np.log2(total + kinds), kinds) - np.log2(count)


def train(samples: dict[str, pa.Array]) -> Model:
    """A model of the languages from sample texts of each."""
    langs = sorted(samples)
    counted = [[np.unique(keys, return_counts=True) for keys in _runs(X.texts_of(samples[x]))] for x in langs]
    size = 1 << WIDE
    pairs = np.full((size, size, len(langs)), 8.0, np.float32)
    for j, runs in enumerate(counted):
        ctx, skip, own = _contexts(*runs[0])
        if len(ctx):
            pairs[:, :, j] = 8.0 + skip[0]
            pairs[:, runs[0][0].astype(int), j] = own
        ctx, skip, own = _contexts(*runs[1])
        pairs[ctx.astype(int), :, j] += skip[:, None]
        pairs[(runs[1][0] >> np.uint64(WIDE)).astype(int), (runs[1][0] & np.uint64(size - 1)).astype(int), j] = own
    pairs = pairs.reshape(size * size, len(langs))
    shorter, cost, tables = None, pairs, []
    for k in range(2, ORDER + 1):
        keys = np.unique(np.concatenate([runs[k][0] for runs in counted]))
        homes = np.unique(keys >> np.uint64(WIDE))
        last = keys & np.uint64((1 << (WIDE * k)) - 1)
        below = cost[last.astype(int) if shorter is None else np.searchsorted(shorter, last)].astype(float)
        skips, where = np.zeros((len(homes), len(langs))), np.searchsorted(homes, keys >> np.uint64(WIDE))
        for j, runs in enumerate(counted):
            ctx, skip, own = _contexts(*runs[k])
            skips[np.searchsorted(homes, ctx), j] = skip
            below[:, j] += skips[where, j]
            below[np.searchsorted(keys, runs[k][0]), j] = own
        tables.append(Table(*_stored(keys, below), *_stored(homes, skips)))
        shorter, cost = keys, below
    return Model(langs, pairs, tables)


def code_lengths(model: Model, t: X.Texts) -> np.ndarray:
    """Bits that each text takes in each language."""
    out = np.zeros((len(t), len(model.langs)))
    if not len(t.data):
        return out
    runs = _runs(t)
    bits = np.zeros((len(t.data), len(model.langs)), np.float32)
    left = np.arange(len(t.data))
    for k in range(ORDER, 1, -1):
        table, keys = model.tables[k - 2], runs[k][left]
        at = _found(table.slots, keys)
        hit = at >= 0
        bits[left[hit]] += table.cost[at[hit]]
        left, keys = left[~hit], keys[~hit]
        home = _found(table.homes, keys >> np.uint64(WIDE))
        known = home >= 0
        bits[left[known]] += table.skip[home[known]]
    bits[left] += model.pairs[runs[1][left].astype(np.int64)]
    full = np.flatnonzero(np.diff(t.bounds))
    out[full] = np.add.reduceat(bits, t.bounds[:-1][full], axis=0, dtype=np.float64)
    return out


def fit(docs: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Trains on rows of documents (doc_id, text, lang) that `usable` admits; None where there are none.

    About `sample_rows` rows of each language are drawn by a hash, so reruns draw the same.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample_rows / n))) for x, n in sorted(sizes.items())])
    drawn = rows.where(draw <= rate).select("lang", "text").toArrow()
    lang = drawn.column("lang")
    samples = {x: drawn.filter(pc.equal(lang, x)).column("text") for x in sorted(sizes)}
    model = train({x: v for x, v in samples.items() if len(v)})
    give_back()
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and bits_per_byte to documents with a text column; other columns stay as they are."""
    names = {n: unused(docs, n) for n in ("lang_pred", "score", "bits_per_byte")}
    if model is None:
        return docs.withColumns({names["lang_pred"]: F.lit("und"), names["score"]: F.lit(0.0), names["bits_per_byte"]: F.lit(8.0)})
    letter = unused(docs, "has_letter")
    langs = np.array(model.langs, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch, "text"):
                t = X.texts_of(part.column("text"))
                bits, size = code_lengths(model, t), np.diff(t.bounds)
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(best)), best]
                # Evidence of long texts counts as that of 64 bytes, so that scores stay apart.
                scale = np.minimum(1, 64 / np.maximum(size, 1))
                score = 1 / np.exp2(-(bits - low[:, None]) * scale[:, None]).sum(axis=1)
                known = part.column(letter).to_numpy(zero_copy_only=False).astype(bool)
                new = [
                    pa.array(np.where(known, langs[best], "und"), pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                    pa.array(np.where(known, low / np.maximum(size, 1), 8.0)),
                ]
                keep = [i for i, n in enumerate(part.schema.names) if n != letter]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *new], [*(part.schema.names[i] for i in keep), *names.values()])

    schema = docs.withColumns({names["lang_pred"]: F.lit(""), names["score"]: F.lit(0.0), names["bits_per_byte"]: F.lit(0.0)}).schema
    return docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte): as identify, without carrying the texts back."""
    return identify(docs.select("doc_id", "text"), model).drop("text")


def keep_identified(docs: DataFrame, model: Model | None, max_bits: float = MAX_BITS) -> DataFrame:
    """The documents that have a language: those of `und`, and those no language can code well, go."""
    scored = identify(docs, model)
    lang, bits = scored.columns[-3], scored.columns[-1]
    return scored.where((F.col(lang) != "und") & (F.col(bits) <= max_bits)).select(*docs.columns)
