"""Bounded samples of labelled documents, and dense text features that classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import _text as X


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """(text, y, weight) of about `rows` rows at most of each class among the labelled documents that `usable` (of doc_id) admits.

    Rows are drawn by a hash of doc_id, so reruns draw the same; weight undoes
    the rates, that the classes keep their shares. The drawn labels are
    broadcast: there are at most about two times `rows` of them.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, rows / max(sizes.get(1, 0), 1)))).otherwise(F.lit(min(1.0, rows / max(sizes.get(0, 0), 1))))
    drawn = known.withColumn("rate", rate).where(draw <= F.col("rate")).select("doc_id", "y", (1 / F.col("rate")).alias("weight"))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "y", "weight")


def per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of mask over each text, or over any other spans that bounds cuts."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def members(chars: str) -> np.ndarray:
    """A table of 256 booleans: the bytes of some ASCII characters."""
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


UPPER, LOWER, DIGIT = members("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), members("abcdefghijklmnopqrstuvwxyz"), members("0123456789")
HIGH = np.arange(256) >= 128
LETTER = UPPER | LOWER | HIGH
SYMBOL = members("#$%&*+<=>@[]^_`{|}~/\\")


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """part / whole, 0 where whole is 0."""
    return part / np.maximum(whole, 1)


def repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n owners of keys: different keys, and the count of the most frequent one."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(head)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, o[at], np.diff(np.append(at, len(k))))
    return np.bincount(o[at], minlength=n), most


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each feature of each row."""
    return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(x), 0), np.int64)


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature at most bins - 1 cut points between its quantiles."""
    out = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
            out.append(values)
        else:
            out.append((values[1:] + values[:-1]) / 2)
    return out


def collected(features: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, weight) from rows (x array<double>, y, weight) of a bounded sample, in an order that does not depend on partitions."""
    rows = features.select("x", "y", "weight").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if rows.num_rows else np.zeros((0, width))
    y, w = (rows.column(c).to_numpy().astype(float) for c in ("y", "weight"))
    order = np.lexsort((*x.T[::-1], y)) if len(y) else np.zeros(0, int)
    return x[order], y[order], w[order]


__all__ = ["X", "binned", "collected", "cuts_of", "labelled", "members", "per_text", "repeats", "share", "sigmoid"]
