"""Vectorised text kernels shared by the Arrow-based operators.

Everything here works on one Arrow chunk of strings at a time: word bounds and
64-bit word hashes of all texts of the chunk come from a handful of numpy
passes over the chunk's UTF-8 bytes, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; the temporaries of the kernels are about 40 times this.
CHUNK_BYTES = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _inverse(odd: int) -> int:
    """Inverse of an odd number modulo 2**64, by Newton's iteration."""
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) & _MASK
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown for later calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base & _MASK, dtype=_U)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE_CODE = mix(np.arange(256, dtype=_U), 77)


def space_table() -> np.ndarray:
    """True for the separators of `[^\\x20\\x09-\\x0D]+`."""
    t = np.zeros(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


SPACE = space_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Texts:
    """The bytes of some texts: data, and bounds so that text i is data[bounds[i]:bounds[i+1]]."""

    __slots__ = ("bounds", "data")

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def lowered(self) -> Texts:
        return Texts(_LOWER[self.data], self.bounds)


def texts_of(column: pa.Array) -> Texts:
    """Texts of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[bounds[0] : bounds[-1]], bounds - bounds[0])


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about `limit` bytes of the column each (a longer text is a slice of its own)."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    group = (np.cumsum(lengths, dtype=np.int64) - lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def word_bounds(t: Texts, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte bounds of all words, and the index of each text's first word (one more at the end)."""
    n = len(t.data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(t) + 1, np.int64)
    inside = ~separators[t.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = t.bounds[:-1][t.bounds[:-1] < n]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = t.bounds[1:][t.bounds[1:] > 0] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, t.bounds)


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE, salt: int = 0) -> np.ndarray:
    """64-bit hashes of codes[start:end] for many spans at once, from one prefix sum of a polynomial modulo 2**64."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, dtype=_U)
        np.cumsum(codes * powers(base, len(codes)), out=total[1:])
        back = powers(_inverse(base), len(codes) + 1)
        h = (total[end] - total[start]) * back[start]
        return mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93), salt)


def word_hashes(t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE_CODE[t.data], start, end)


_PAIR = 0xC2B2AE3D27D4EB4F | 1


def window_hashes(words: np.ndarray, first: np.ndarray, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, at): hashes of all runs of `size` words within one text, and the index of each run's first word."""
    counts = np.diff(first)
    runs = np.maximum(counts - size + 1, 0)
    if not runs.sum():
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = ranges(first[:-1], runs)
    return span_hashes(mix(words, salt + 1), at, at + size, _PAIR, salt), at


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, .. (count[i] numbers) for all i, one after the other."""
    total = int(count.sum())
    offset = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(start - offset, count)
