"""Vectorised word and n-gram hashing straight on the UTF-8 buffers of Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Those six bytes never occur
inside a multi-byte UTF-8 sequence, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are hashed in slices of about this many bytes, which keeps the temporaries in cache.
SLICE_BYTES = 1 << 18

BYTE_MULTIPLIER = 0x9E3779B97F4A7C15
WORD_MULTIPLIER = 0xD6E8FEB86659FD93
BYTE_CODES = np.random.default_rng(20240117).integers(1, 2**64, 256, dtype=np.uint64)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd ``base`` and of its inverse modulo 2**64, at least ``n`` of each (the longest made is kept)."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(1 << 16, n + n // 8)
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        held = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return held


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows, from zero) and bytes of a string column; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer row stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Word boundaries and hashes of a run of texts laid end to end."""

    def __init__(self, off: np.ndarray, raw: np.ndarray) -> None:
        self.off, self.raw = off, raw
        n = len(raw)
        inside = ~IS_SPACE[raw]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = off[:-1][off[:-1] < n]
            first[edge] = inside[edge]
            edge = off[1:][off[1:] > 0] - 1
            last[edge] = inside[edge]
        self.inside = inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: index of the first word of each text, and one past the last
        self.begin = np.searchsorted(self.start, off)
        self.count = np.diff(self.begin)
        self.text = np.repeat(np.arange(len(off) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = powers(BYTE_MULTIPLIER, len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(BYTE_CODES[self.raw] * up[: len(self.raw)], out=total[1:])
        return mix64((total[self.end] - total[self.start]) * down[self.start])

    def windows(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words inside one text, and the index of each run's first word."""
        n = len(words)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = powers(WORD_MULTIPLIER, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=total[1:])
        whole = mix64((total[width:] - total[:-width]) * down[: n - width + 1])
        at = np.flatnonzero(self.text[width - 1 :] == self.text[: n - width + 1])
        return whole[at], at


def covered(n: int, at: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` positions lie in [a, a + width) for some a of ``at`` (sorted or not)."""
    edge = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + width, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
