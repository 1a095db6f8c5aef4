"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: of the words of labelled documents and of their first
4, 5 and 6 letters, those that occur in enough documents and almost only in
toxic ones. Dense features are how much of a text such words make up and how
sure they are, how near the second person stands to them, the rates of second
person, capitals and punctuation, and signs of obfuscation (symbols and digits
inside words, stretched letters). While a labelled document trains the trees,
its own label is left out of the lexicon's counts. Boosting fits shallow trees
to histograms of binned features; isotonic regression on out-of-fold sums turns
the trees' sum into a probability.

Defined results: null text counts as empty and is scored as well; a very long
text is a batch of its own, whole; without labelled rows every score is 0; with
one class only, scores are that class; texts with equal features tie. Rows that
repeat a doc_id are each scored; an empty table gives an empty one. A column
named toxicity stays, and the new one is toxicity_. labels, lang, source and
doc_id never enter a score.
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
from parley.llm._shared import checkpointed, unused

#: Rows of each class that training reads at most, about; the lexicon holds terms of these rows alone.
SAMPLE_ROWS = 10_000
#: Documents a term occurs in at least; the part of them that is toxic at least.
LEAST_DOCS, LEAST_TOXIC = 3, 0.7
PREFIXES = (4, 5, 6)
TREES, DEPTH, BINS, RATE, RIDGE, FOLDS = 60, 3, 32, 0.2, 1.0, 3
#: Words between a lexicon word and the second person at most.
NEAR = 4
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself yourselves u ur ya du dich dir dein deine deinen deinem deiner ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti tus tuyo tuya usted ustedes vosotros vuestro vuestra"
).split()

FEATURES = (
    "log_words", "surest", "surest_second", "sure_sum", "sure_count", "sure_kinds", "sure_density", "prefix_count", "prefix_density", "near_second_person",
    "second_person", "capitals", "shouted", "exclamations", "punctuation", "symbols_inside", "digits_inside", "stretched",
)

_LETTERS = ~(X.SPACE | L.members("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
_OTHER = ~_LETTERS
_MARK, _PUNCTUATION = L.members("!"), L.members("!?.,;:")
_INSIDE = L.members("@$*#!%&+_")


def _split(t: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first, terms): words of letters and digits, and four hashes for each: itself and its first letters (0 where shorter)."""
    low = t.lowered()
    start, end, first = X.word_bounds(low, _OTHER)
    hashes = [X.word_hashes(low, start, end)]
    for k in PREFIXES:
        h = X.mix(X.word_hashes(low, start, np.minimum(start + k, end)), k)
        hashes.append(np.where(end - start > k, h, np.uint64(0)))
    return start, end, first, np.stack(hashes, axis=1)


_PERSON = np.sort(np.concatenate([X.word_hashes(t, *X.word_bounds(t)[:2]) for t in [X.texts_of(pa.array(SECOND_PERSON))]]))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, a, weighted n, weighted a) summed up over a batch: documents with a term, and toxic ones among them."""
    for batch in batches:
        for part in X.pieces(batch, "text"):
            _, _, first, terms = _split(X.texts_of(part.column("text")))
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            doc, term = np.tile(doc, terms.shape[1]), terms.T.reshape(-1)
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            head = term != 0
            head[1:] &= (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
            doc, term = doc[head], term[head]
            y, w = (part.column(c).to_numpy().astype(float) for c in ("y", "weight"))
            kinds, at = np.unique(term, return_inverse=True)
            sums = [np.bincount(at, v, len(kinds)) for v in (np.ones(len(at)), y[doc], w[doc], (w * y)[doc])]
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), *map(pa.array, sums)], ["term", "n", "a", "wn", "wa"])


@dataclass
class Lexicon:
    """Sorted terms with their documents n, toxic ones a, and the toxic share p of all training documents."""

    terms: np.ndarray
    n: np.ndarray
    a: np.ndarray
    p: float

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term, -1 where it is not in the lexicon."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def odds(self, at: np.ndarray, own_n: np.ndarray | float = 0.0, own_a: np.ndarray | float = 0.0) -> np.ndarray:
        """Log odds of toxicity given the term, less the odds of any document; without the counts that a document itself adds."""
        n, a = np.maximum(self.n[at] - own_n, 0), np.maximum(self.a[at] - own_a, 0)
        q = (np.minimum(a, n) + 2 * self.p) / (n + 2)
        return np.log(q / (1 - q)) - np.log(self.p / (1 - self.p))


def features(column: pa.Array, lexicon: Lexicon, y: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """One row of FEATURES for each text; with y and weight, the texts are training rows whose own labels are left out."""
    t = X.texts_of(column)
    n, d, b = len(t), t.data, t.bounds
    start, end, first, terms = _split(t)
    count, size = np.diff(first), np.diff(b)
    owner = np.repeat(np.arange(n), count)
    at = lexicon.find(terms)
    place = np.where(at[:, 0] >= 0, at[:, 0], at[:, 1:].max(axis=1, initial=-1))
    hit = np.flatnonzero(place >= 0)
    whole = at[hit, 0] >= 0
    o = owner[hit]
    own_n, own_a = (0.0, 0.0) if y is None else (weight[o], (weight * y)[o])
    odds = lexicon.odds(place[hit], own_n, own_a) if len(hit) else np.zeros(0)
    sure = odds > 1.5
    order = np.lexsort((-odds, place[hit], o))
    head = np.ones(len(order), bool)
    head[1:] = (o[order][1:] != o[order][:-1]) | (place[hit][order][1:] != place[hit][order][:-1])
    kinds = order[head]  # one place of each kind
    ranked = kinds[np.lexsort((-odds[kinds], o[kinds]))]
    rank = np.arange(len(ranked)) - np.searchsorted(o[ranked], o[ranked])
    best, second = np.zeros(n), np.zeros(n)
    best[o[ranked[rank == 0]]] = odds[ranked[rank == 0]]
    second[o[ranked[rank == 1]]] = odds[ranked[rank == 1]]
    by = lambda who, values=None: np.bincount(who, values, n)[:n]
    person = np.zeros(len(start), bool)
    if len(start):
        i = np.minimum(np.searchsorted(_PERSON, terms[:, 0]), len(_PERSON) - 1)
        person = _PERSON[i] == terms[:, 0]
    so_far = np.concatenate([[0], np.cumsum(person)])
    strong = hit[sure]
    lo, hi = np.maximum(strong - NEAR, first[:-1][owner[strong]]), np.minimum(strong + NEAR + 1, first[1:][owner[strong]])
    near = so_far[hi] > so_far[lo]
    # Words as a reader sees them, with the symbols inside.
    ws, we, wf = X.word_bounds(t)
    wo = np.repeat(np.arange(n), np.diff(wf))
    inner = np.zeros(len(d), bool)
    letter = L.LETTER[d]
    inner[1:-1] = letter[:-2] & letter[2:]
    bytes_to = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    inside = lambda mask: np.diff(bytes_to(mask)[np.stack([ws, we])], axis=0)[0] > 0 if len(ws) else np.zeros(0, bool)
    low = X._LOWER[d]
    long_ = np.zeros(len(d), bool)
    long_[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & letter[2:]
    shouted = inside(L.UPPER[d]) & ~inside(L.LOWER[d]) & (we - ws > 2)
    words = np.diff(wf)
    cols = [
        np.log1p(count), best, second, by(o[sure], odds[sure]), by(o[sure]), by(o[kinds[sure[kinds]]]), L.share(by(o[sure]), count), by(o[sure & ~whole]), L.share(by(o[sure & ~whole]), count), by(owner[strong[near]]),
        L.share(by(owner, person), count), L.share(L.per_text(L.UPPER[d], b), size), L.share(by(wo, shouted), words), L.share(L.per_text(_MARK[d], b), size), L.share(L.per_text(_PUNCTUATION[d], b), size),
        L.share(by(wo, inside(_INSIDE[d] & inner)), words), L.share(by(wo, inside(L.DIGIT[d] & inner)), words), L.share(by(wo, inside(long_)), words),
    ]
    return np.stack([np.asarray(c, float) for c in cols], axis=1)


@dataclass
class Trees:
    """Boosted trees of DEPTH levels: a feature and a cut for each inner node, a value for each leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] >= c[node])
            total += v[node - (2**DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
    """Gradient boosting of the log loss on binned features."""
    w = w / w.mean()
    p = (w[y == 1].sum() + 0.5) / (w.sum() + 1)
    base, cuts = float(np.log(p / (1 - p))), L.cuts_of(x, BINS)
    bins, raw, wide = L.binned(x, cuts), np.full(len(y), base), BINS
    inner = 2**DEPTH - 1
    made = []
    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        q = L.sigmoid(raw)
        g, h = w * (y - q), w * q * (1 - q)
        feature, cut, value, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(inner + 1), np.zeros(len(y), int)
        for level in range(DEPTH):
            base_node, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-9)
            place = np.zeros((nodes, 2), int) - 1
            for j in range(x.shape[1]):
                key = (node - base_node) * wide + bins[:, j]
                cg, ch = (np.bincount(key, v, nodes * wide).reshape(nodes, wide).cumsum(1) for v in (g, h))
                tg, th = cg[:, -1:], ch[:, -1:]
                gain = cg**2 / (ch + RIDGE) + (tg - cg) ** 2 / (th - ch + RIDGE) - tg**2 / (th + RIDGE)
                gain = gain[:, : len(cuts[j])]
                if gain.shape[1]:
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(nodes), k]
                    up = top > best
                    best[up], place[up] = top[up], np.stack([np.full(nodes, j), k], axis=1)[up]
            for i, (j, k) in enumerate(place):
                if j >= 0:
                    feature[base_node + i], cut[base_node + i] = j, cuts[j][k]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] >= cut[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        raw += value[leaf]
        made.append((feature, cut, value))
    cols = [np.array(c) for c in zip(*made, strict=True)] if made else [np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1))]
    return Trees(base, *cols)


def isotonic(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raw, probability) at the means of the pooled blocks; probabilities do not fall, and none is 0 or 1."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted y, weighted raw
    for r, t, v in zip(raw[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        blocks.append([v, v * t, v * r])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([[b[2] / b[0], (b[1] + 0.01) / (b[0] + 0.02)] for b in blocks]).reshape(-1, 2)
    return at[:, 0], np.maximum.accumulate(at[:, 1])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    probability: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        return np.interp(self.trees.raw(features(column, self.lexicon)), self.at, self.probability)


def train(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Model:
    """Trees on all rows, calibrated on sums that each fold gets from trees without it."""
    w = w / w.mean()
    fold = np.arange(len(y)) % FOLDS  # rows come ordered by class and features, so folds are alike
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            raw[fold == k] = boost(x[fold != k], y[fold != k], w[fold != k]).raw(x[fold == k]) if (fold != k).any() else 0
    return Model(lexicon, boost(x, y, w), *isotonic(raw, y, w))


def learn_lexicon(sample: DataFrame, p: float) -> Lexicon:
    """The lexicon of labelled rows (text, y, weight), of which the weighted part p is toxic."""
    sums = sample.mapInArrow(_counting, "term long, n double, a double, wn double, wa double").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "a", "wn", "wa")])
    sure = sums.where((F.col("n") >= LEAST_DOCS) & (F.col("a") >= LEAST_TOXIC * F.col("n")) & (F.col("wa") >= LEAST_TOXIC * F.col("wn")))
    rows = sure.select("term", "wn", "wa").toArrow()
    term, n, a = (rows.column(c).to_numpy() for c in ("term", "wn", "wa"))
    term = term.view(np.uint64)
    order = np.argsort(term)
    return Lexicon(term[order], n[order], a[order], p)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Trains on labels (doc_id, toxic) whose doc_id `usable` admits, about `sample_rows` rows of each class at most; None without any."""
    sample = checkpointed(L.labelled(docs, labels, "toxic", usable, sample_rows))
    total, toxic = sample.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("y"))).first()
    if not total:
        return None
    lexicon = learn_lexicon(sample, (toxic + 0.5) / (total + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch, "text"):
                x = features(part.column("text"), lexicon, *(part.column(c).to_numpy().astype(float) for c in ("y", "weight")))
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1))
                yield pa.RecordBatch.from_arrays([lists, part.column("y"), part.column("weight")], ["x", "y", "weight"])

    return train(lexicon, *L.collected(sample.mapInArrow(run, "x array<double>, y int, weight double"), len(FEATURES)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds toxicity, 0 to 1, to documents with a text column; other columns stay as they are."""
    name = unused(docs, "toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch, "text"):
                s = model.score(part.column("text")) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score), without carrying the texts back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch, "text"):
                s = model.score(part.column("text")) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
