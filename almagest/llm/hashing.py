"""Vectorised word splitting and 128-bit fingerprints over one block of documents.

Everything here is plain numpy over one concatenated byte buffer: no Python work per word or per byte.
A fingerprint has two 64-bit lanes with independent random tables.  Two different strings share both
lanes with probability around 2**-120, which the operators treat as equality.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240613))
_BYTE_TABLES = _RNG.integers(0, 2**64, size=(2, 256), dtype=U)
_RATIOS = (0x9E3779B97F4A7C15 | 3, 0xD6E8FEB86659FD93 | 3)
COEFFICIENTS = _RNG.integers(0, 2**64, size=(2, 4096), dtype=U) | U(1)

#: What separates words: space and 0x09-0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser that spreads every input bit over the output."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@functools.lru_cache(maxsize=8)
def _powers(lane: int, size: int, inverse: bool) -> np.ndarray:
    ratio = pow(_RATIOS[lane], -1, 2**64) if inverse else _RATIOS[lane]
    out = np.full(size, ratio, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(lane: int, size: int, inverse: bool = False) -> np.ndarray:
    """ratio**0, ratio**1, ... modulo 2**64, at least ``size`` of them (tables are kept by power of two)."""
    return _powers(lane, 1 << max(10, int(size - 1).bit_length()), inverse)[:size]


class ByteHash:
    """Prefix sums over a buffer, from which the hash of any range takes O(1)."""

    def __init__(self, buf: np.ndarray, lane: int) -> None:
        self.lane, self.size = lane, len(buf)
        self.sums = np.zeros(len(buf) + 1, dtype=U)
        np.cumsum(_BYTE_TABLES[lane][buf] * powers(lane, len(buf)), out=self.sums[1:], dtype=U)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = self.sums[end] - self.sums[start]
        raw *= powers(self.lane, self.size + 1, inverse=True)[start]
        raw += (end - start).astype(U) * U(0xA24BAED4963EE407)
        return mix(raw)


class RangeHash:
    """``ByteHash`` of a whole block at once: powers come from two small tables, so that only the sums grow with the buffer."""

    LOW = 1 << 11

    def __init__(self, buf: np.ndarray, lane: int) -> None:
        self.inverse = self._tables(lane, len(buf) + 1, True)
        self.sums = np.zeros(len(buf) + 1, dtype=U)
        high, low = self._tables(lane, len(buf), False)
        for a in range(0, len(buf), self.LOW):
            part = _BYTE_TABLES[lane][buf[a : a + self.LOW]]
            part *= low[: len(part)]
            part *= high[a // self.LOW]
            self.sums[a + 1 : a + 1 + len(part)] = np.cumsum(part, dtype=U) + self.sums[a]

    def _tables(self, lane: int, size: int, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
        ratio = pow(_RATIOS[lane], -1, 2**64) if inverse else _RATIOS[lane]
        step = np.full(size // self.LOW + 1, pow(ratio, self.LOW, 2**64), dtype=U)
        step[0] = 1
        return np.cumprod(step, dtype=U), powers(lane, self.LOW, inverse)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = self.inverse
        raw = self.sums[end] - self.sums[start]
        raw *= high[start // self.LOW]
        raw *= low[start % self.LOW]
        raw += (end - start).astype(U) * U(0xA24BAED4963EE407)
        return mix(raw)


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int, chunk: int = 1 << 17) -> np.ndarray:
    """Hash of ``buf[start[k]:end[k]]`` for every k, starts ascending; a chunk of the buffer at a time, for bounded memory."""
    out = np.empty(len(start), dtype=U)
    a = 0
    while a < len(start):
        z = max(a + 1, int(np.searchsorted(start, start[a] + chunk)))
        base, top = int(start[a]), int(end[a:z].max())
        out[a:z] = ByteHash(buf[base:top], lane).of(start[a:z] - base, end[a:z] - base)
        a = z
    return out


def joined(texts: list[bytes], separator: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by the separator; where each text starts and ends in it."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    buf = np.frombuffer(separator.join([*texts, b""]), dtype=np.uint8)
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(lengths[:-1] + len(separator), out=starts[1:])
    return buf, starts, starts + lengths


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of every text of a block, in order.

    ``start``/``end``: byte ranges in ``buf``; ``first``/``count``: each text's first word and number of words.
    """

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        self.buf, self.text_start, self.text_end = joined(texts)
        if lower:
            self.buf = _LOWER[self.buf]
        space = _SPACE[self.buf]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.searchsorted(self.start, self.text_end) - self.first
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, lane: int) -> np.ndarray:
        if lane not in self._hashes:
            self._hashes[lane] = range_hashes(self.buf, self.start, self.end, lane)
        return self._hashes[lane]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first)), self.count)


def windows(values: np.ndarray, size: int, lane: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values; element i is the run that starts at i."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    acc = np.zeros(n, dtype=U)
    for j in range(size):
        acc += COEFFICIENTS[lane, j] * values[j : j + n]
    return mix(acc)


def whole_windows(first: np.ndarray, count: np.ndarray, size: int, total: int) -> np.ndarray:
    """Boolean over run starts (as ``windows`` has them): does the run stay inside one text?"""
    n = max(0, total - size + 1)
    change = np.zeros(n + 1, dtype=np.int32)
    ok = count >= size
    np.add.at(change, first[ok], 1)
    np.add.at(change, first[ok] + count[ok] - size + 1, -1)
    return np.cumsum(change[:n]) > 0
