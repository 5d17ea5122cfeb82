"""Vectorised 64-bit hashes of words and word n-grams over a byte buffer."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: ASCII white space ends a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, base & (2**64 - 1), np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(buf: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~separator[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of buf[start:end] for every span, the same wherever the span stands."""
    terms = (buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(buf) + 1)[starts])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes; entry i covers words i .. i+n-1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + words[k : len(words) - n + 1 + k]
    return mix(out)
