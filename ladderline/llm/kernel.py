"""Vectorised text kernel: words, lines and hashes of whole Arrow batches in numpy.

Texts are taken as UTF-8 bytes. Words are runs of bytes other than space and 0x09-0x0D, which
equals splitting code points, since those separators are single bytes. All hashes are 64 bits wide
and depend on nothing but the text, so a retried task gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, U), np.ones(1, U)]
#: Powers that a worker keeps.
KEPT = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial's base and of its inverse, modulo 2**64. Up to KEPT of them stay for the next call; more are made for a very long text and go with it."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    n = max(n, min(2 * len(_POWERS[0]), KEPT))
    found = []
    for base in (_STEP, pow(_STEP, -1, 2**64)):
        steps = np.full(n, base, U)
        steps[0] = 1
        found.append(np.cumprod(steps))
    if n <= KEPT:
        _POWERS[:] = found
    return found[0], found[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word (the finaliser of splitmix64), in place."""
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span; the same values give the same hash wherever they stand."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def slices(column, limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about limit bytes at most; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words of some texts: byte spans, each word's row, and for each row the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.inside = inside = ~SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.ptr))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, table: np.ndarray = LOWER) -> np.ndarray:
        """A hash of each word, its bytes seen through the table."""
        return span_hash(_BYTE[table[self.data]], self.start, self.end)


def word_hash(word: str | bytes) -> int:
    """The hash Words.hashes() gives this word."""
    b = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(span_hash(_BYTE[LOWER[b]], np.array([0]), np.array([len(b)]))[0])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U(0xA24BAED4963EE407)
        out += h[j : n + j]
    return mix(out)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each row has."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def id_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """A slot of a bitmap for each integer."""
    return (mix(ids.astype(np.int64).view(U) + U(_STEP)) >> U(64 - bits)).astype(np.int64)
