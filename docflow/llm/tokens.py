"""Words and rolling hashes of many texts at once, on the raw UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_FAR = np.cumprod(np.concatenate([[1], np.full(1023, 0xD6E8FEB86659FD93, np.uint64)]).astype(np.uint64), dtype=np.uint64)
_BASE = np.uint64(0x5851F42D4C957F2D)

#: White space of ASCII, and everything of ASCII but letters and digits.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Words(NamedTuple):
    start: np.ndarray  # byte of the first character
    end: np.ndarray  # byte after the last
    doc: np.ndarray  # row of the text
    first: np.ndarray  # number of words before each row, and in all


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of Latin-1 letters in UTF-8; other letters stay."""
    out = _LOWER[data]
    if len(data) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[capital] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    inside = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, doc, np.searchsorted(start, offsets, "left"))


def hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """64 bits of each word: a polynomial over random values of its bytes."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    sizes = w.end - w.start
    at = np.cumsum(sizes) - sizes
    rel = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    value = _BYTE[data[rel + np.repeat(w.start, sizes)]] * _POW[rel & 1023]
    if sizes.max() > 1024:
        value *= _FAR[(rel >> 10) & 1023]
    return mix(np.add.reduceat(value, at) + sizes.astype(np.uint64))


def windows(h: np.ndarray, w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of each window of size words of one text, and each window's first word."""
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - size + 1
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    rolling = np.zeros(n, np.uint64)
    for k in range(size):
        rolling = rolling * _BASE + h[k : k + n]
    return mix(rolling[at]), at
