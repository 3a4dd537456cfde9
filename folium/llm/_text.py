"""Vectorised reading of Arrow text batches: lower-cased bytes, words and 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 256), _R, U)]), dtype=U)
    return _POWERS


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of uint64 values (the splitmix64 finaliser)."""
    x = x + U((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Texts:
    """Some rows' texts as one byte array. data: bytes (A-Z lower-cased unless raw); at: row offsets, one more than rows."""

    def __init__(self, data: np.ndarray, at: np.ndarray, raw: bool = False):
        self.data = data if raw else _LOWER[data]
        self.at = at
        self.rows = len(at) - 1

    def words(self, hashed: bool = True) -> "Texts":
        """Sets starts, ends (byte offsets of words), word_at (words before each row, one more than rows) and hashes."""
        space = _SPACE[self.data]
        inside = ~space
        first = inside.copy()
        first[1:] &= space[:-1]
        edges = self.at[:-1][self.at[:-1] < len(inside)]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= space[1:]
        edges = self.at[1:][self.at[1:] > 0] - 1
        last[edges] = inside[edges]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.word_at = np.searchsorted(self.starts, self.at)
        self.hashes = np.zeros(0, U)
        if hashed and len(self.starts):
            lens = self.ends - self.starts
            off = np.concatenate([[0], np.cumsum(lens)[:-1]])
            pos = np.arange(off[-1] + lens[-1], dtype=np.int64) - np.repeat(off, lens)
            value = self.data[inside].astype(U) + U(1)
            value *= _powers(int(lens.max()) + 1)[pos]
            self.hashes = mix(np.add.reduceat(value, off), 1)
        return self


def texts(column: pa.Array, most: int = 1 << 20, raw: bool = False) -> Iterator[tuple[int, Texts]]:
    """(first row, Texts) for consecutive runs of rows of at most `most` bytes, at least one row each; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], raw)
        row = end


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words of one text; with fewer words the whole sequence as one."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U)
    width = min(k, n)
    out = np.zeros(n - width + 1, U)
    for j in range(width):
        out = mix(out + hashes[j : n - width + 1 + j], 2)
    return out


def shingle_sets(part: Texts, k: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingles, sorted. Same values as shingles()."""
    part.words()
    h, at = part.hashes, part.word_at
    rolled = shingles(h, k) if len(h) >= k else np.zeros(0, U)
    for i in range(part.rows):
        first, n = at[i], at[i + 1] - at[i]
        own = rolled[first : first + n - k + 1] if n >= k else shingles(h[first : first + n], k)
        yield np.unique(own)
