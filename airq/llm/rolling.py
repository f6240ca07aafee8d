"""Hashes of all windows of a byte buffer, and sliding minima, in numpy.

A window's hash is a polynomial modulo 2**64, mixed at the end. It only proposes
candidates and decides where a window travels; equality is checked on bytes.
"""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over the whole word (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n``."""
    return _powers(1 << max(10, int(n - 1).bit_length()), base)[:n]


def prefix(codes: np.ndarray) -> np.ndarray:
    """``prefix[i]`` is the sum of ``(codes[j] + 1) * BASE**j`` for j below i."""
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes)), out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of every ``[start, end)`` of the coded sequence."""
    inverse = powers(len(sums), pow(BASE, -1, 1 << 64))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of every ``k`` consecutive codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = prefix(codes)
    inverse = powers(len(sums), pow(BASE, -1, 1 << 64))
    return mix((sums[k:] - sums[:n]) * inverse[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    if len(x) < w:
        return x[:0]
    held, have = x, 1
    while have < w:
        step = min(have, w - have)
        held = np.minimum(held[: len(held) - step], held[step:])
        have += step
    return held


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Mask of the rows that differ from the row before in any column."""
    n = len(columns[0])
    first = np.zeros(n, dtype=bool)
    if n:
        first[0] = True
        for c in columns:
            first[1:] |= c[1:] != c[:-1]
    return first
