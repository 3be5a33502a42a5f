"""Vectorised splitting and hashing of words over whole Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Odd multipliers of the 64-bit finaliser (splitmix64).
_M1, _M2, GOLDEN = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    h = h ^ (h >> _U(30))
    h = h * _M1
    h = h ^ (h >> _U(27))
    h = h * _M2
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_POWERS = np.ones(1, np.uint64)
_STEP = _U(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is neither letter nor digit ends a word here.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        size = max(64, 1 << (n - 1).bit_length())
        _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _STEP)]))
    return _POWERS[:n]


@dataclass
class Words:
    """Words of several texts: byte range of each, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1
    offsets: np.ndarray | None = None  # of the texts in data; len(texts) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, table: np.ndarray = _BYTE) -> np.ndarray:
        """A 64-bit hash of the bytes of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        length = self.ends - self.starts
        at = np.cumsum(length) - length
        inside = np.arange(int(length.sum())) - np.repeat(at, length)
        value = table[self.data[inside + np.repeat(self.starts, length)]] * powers(int(length.max()))[inside]
        return mix(np.add.reduceat(value, at) + length.astype(np.uint64))


def slices(column: pa.Array, most_bytes: int = 1 << 22, most_rows: int = 512) -> Iterator[tuple[int, int]]:
    """Row ranges with a bounded number of bytes; one longer text is a range of its own."""
    if not len(column):
        return
    offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), np.float64)))])
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        end = min(max(end, at + 1), at + most_rows, len(column))
        yield at, end
        at = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def split(column: pa.Array, gap: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not in ``gap``, text by text."""
    data, offsets = flat(column)
    n = len(data)
    if not n:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), offsets)
    out = gap[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, out[:-1]
    after[-1], after[:-1] = True, out[1:]
    begin = offsets[:-1][np.diff(offsets) > 0]
    before[begin] = True
    after[offsets[1:][np.diff(offsets) > 0] - 1] = True
    starts = np.flatnonzero(before & ~out)
    ends = np.flatnonzero(after & ~out) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """An order-sensitive hash of each ``size`` consecutive word hashes."""
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(size):
        total = total * _STEP + h[j : j + m]
    return mix(total)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``size`` words; a shorter text with any word is one shingle."""
    h, counts = words.hashes(), words.counts
    owner = words.owner()
    hashed = windows(h, size)
    inside = owner[: len(hashed)] == owner[size - 1 :][: len(hashed)] if len(hashed) else np.zeros(0, bool)
    parts, texts = [hashed[inside]], [owner[: len(hashed)][inside]]
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        own = h[words.first[t] : words.first[t + 1]]
        parts.append(mix(windows(own, len(own)) + _U(len(own))))
        texts.append(np.array([t]))
    return np.concatenate(parts), np.concatenate(texts)


def strips(shingle: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number repeats: the c-th copy of a shingle in a text gets a hash of its own.

    The sets of these hashes have the Jaccard similarity of the weighted sets of shingles.
    """
    salted = mix(shingle ^ mix(text.astype(np.uint64) + GOLDEN))
    order = np.argsort(salted, kind="stable")
    s = salted[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    copy = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
    h = shingle[order]
    return np.where(copy == 0, h, mix(h + copy.astype(np.uint64) * GOLDEN)), text[order]
