"""Document quality by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins. Training cycles through the
features; every turn fits a shallow tree (at most LEAVES leaves) to the
gradients of one feature's bins and adds a small step of it to that feature's
table, so the order of features matters little. Then the pairs of features
whose bins explain most of what is left get tables of their own, trained by the
same cycle with trees of two cuts. A score is the sigmoid of the sum of looked
up values: a handful of vectorised additions for a batch of documents.

Features read the whole text: lengths, shares of capitals, digits, symbols and
punctuation, repetition of words, word pairs and lines, line lengths.

Defined results: null text counts as empty and is scored as well; without
labelled rows every score is 0.5; with one class only, scores are its share
with one pseudo-row; texts with equal features tie; a very long text is a batch
of its own, whole. Rows that repeat a doc_id are each scored; an empty table
gives an empty one. A column named quality_score stays, and the new one is
quality_score_. labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import _labelled as L
from parley.llm import _text as X
from parley.llm._shared import unused

#: Rows of each class that training reads at most, about.
SAMPLE_ROWS = 10_000
BINS, PAIR_BINS, LEAVES = 48, 12, 4
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 120, 40, 6, 0.12, 2.0

FEATURES = (
    "log_words", "mean_word", "capitals", "all_caps_words", "digits", "symbols", "pipes", "exclamations", "stops", "high_bytes",
    "symbol_words", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "top_pair", "distinct_lines", "line_words",
)

_PIPE, _MARK, _STOP, _LINE = L.members("|"), L.members("!"), L.members(".,;:?"), L.members("\n")


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    t = X.texts_of(column)
    n, d, b = len(t), t.data, t.bounds
    start, end, first = X.word_bounds(t)
    count, size = np.diff(first), np.diff(b)
    words = X.word_hashes(t, start, end)
    owner = np.repeat(np.arange(n), count)
    spans = np.append(start, len(d)) if len(start) else np.zeros(1, np.int64)
    upper, letters = L.UPPER[d], L.LETTER[d]
    n_upper, n_letter = L.per_text(upper, b), L.per_text(letters, b)
    shouted = (L.per_text(upper, spans) > 1) & (L.per_text(L.LOWER[d], spans) == 0) if len(start) else np.zeros(0, bool)
    marked = L.SYMBOL[d[end - 1]] if len(start) else np.zeros(0, bool)
    kinds, most = L.repeats(words, owner, n)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    pairs, at = X.window_hashes(words, first, 2)
    pair_kinds, pair_most = L.repeats(pairs, owner[at], n)
    n_pairs = np.maximum(count - 1, 0)
    ls, le, lf = X.word_bounds(t, _LINE)
    lines = np.diff(lf)
    line_kinds, _ = L.repeats(X.word_hashes(t, ls, le), np.repeat(np.arange(n), lines), n)
    of = lambda table: L.share(L.per_text(table[d], b), size)
    cols = [
        np.log1p(count), L.share(L.per_text(~X.SPACE[d], b), count), L.share(n_upper, n_letter), L.share(np.bincount(owner, shouted, n), count), of(L.DIGIT), of(L.SYMBOL), of(_PIPE), of(_MARK), of(_STOP), of(L.HIGH),
        L.share(np.bincount(owner, marked, n), count), L.share(kinds, count), L.share(most, count), L.share(np.bincount(owner, same, n), count), L.share(pair_kinds, n_pairs), L.share(pair_most, n_pairs), L.share(line_kinds, lines), np.log1p(L.share(count, lines)),
    ]
    return np.stack(cols, axis=1)


@dataclass
class Model:
    """The sum of `base`, of `tables[j]` at each feature's bin and of `grids` at the bins of pairs."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, at in enumerate(L.binned(x, self.cuts).T):
            total += self.tables[j][at]
        wide = L.binned(x, self.coarse)
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[wide[:, i], wide[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return L.sigmoid(self.raw(x))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A step for each bin, constant on at most LEAVES runs of bins: the run whose best cut gains most is cut next."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        m = np.arange(a + 1, b)
        left, right = (cg[m] - cg[a]) ** 2 / (ch[m] - ch[a] + RIDGE), (cg[b] - cg[m]) ** 2 / (ch[b] - ch[m] + RIDGE)
        gain = left + right - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
        return float(gain.max()), int(m[gain.argmax()])

    runs = [(0, len(g))]
    while len(runs) < LEAVES:
        gains = [best(*r) for r in runs]
        k = max(range(len(runs)), key=lambda i: gains[i][0])
        if gains[k][0] <= 1e-9:
            break
        a, b = runs[k]
        runs[k : k + 1] = [(a, gains[k][1]), (gains[k][1], b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = _step(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, step for each cell) of the best tree that cuts both axes of a grid once."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    cg, ch = (np.cumsum(np.cumsum(v, 0), 1) for v in (g, h))
    sides = []
    for c in (cg, ch):
        top, left, all_ = c[-1:, :-1], c[:-1, -1:], c[-1, -1]
        a = c[:-1, :-1]
        sides.append((a, left - a, top - a, all_ - left - top + a))
    gain = sum(x * x / (w + RIDGE) for x, w in zip(*sides, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(g.shape)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, cols] = _step(sides[0][k][i, j], sides[1][k][i, j])
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Model | None:
    """A model of label 1 from features, labels and weights; None without rows."""
    if not len(y):
        return None
    w = w / w.mean()
    p = (w[y == 1].sum() + 0.5) / (w.sum() + 1)
    base = float(np.log(p / (1 - p)))
    cuts, coarse = L.cuts_of(x, BINS), L.cuts_of(x, PAIR_BINS)
    model = Model(base, cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, [], [])
    if len(np.unique(y)) < 2:
        return model
    fine, wide, raw = L.binned(x, cuts), L.binned(x, coarse), np.full(len(y), base)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            q = L.sigmoid(raw)
            g, h = np.bincount(fine[:, j], w * (y - q), len(table)), np.bincount(fine[:, j], w * q * (1 - q), len(table))
            step = RATE * _tree(g, h)
            table += step
            raw += step[fine[:, j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell, q = wide[:, i] * shape[1] + wide[:, j], L.sigmoid(raw)
        return cell, tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (w * (y - q), w * q * (1 - q)))

    gains = sorted(((_quarters(*grid(i, j)[1])[0], i, j) for i in range(x.shape[1]) for j in range(i)), key=lambda r: (-r[0], r[1:]))
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.grids, strict=True):
            cell, (g, h) = grid(i, j)
            step = RATE * _quarters(g, h)[1]
            table += step
            raw += step.reshape(-1)[cell]
    return model


def _featuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in X.pieces(batch, "text"):
            x = features(part.column("text"))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1))
            yield pa.RecordBatch.from_arrays([lists, part.column("y"), part.column("weight")], ["x", "y", "weight"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Trains on labels (doc_id, quality) whose doc_id `usable` admits, about `sample_rows` rows of each class at most."""
    sample = L.labelled(docs, labels, "quality", usable, sample_rows)
    return train(*L.collected(sample.mapInArrow(_featuring, "x array<double>, y int, weight double"), len(FEATURES)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds quality_score, 0 to 1, to documents with a text column; other columns stay as they are."""
    name = unused(docs, "quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch, "text"):
                s = model.score(features(part.column("text"))) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score), without carrying the texts back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch, "text"):
                s = model.score(features(part.column("text"))) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
