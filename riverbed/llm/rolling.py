"""Vectorised rolling hashes over bytes and words, in unsigned 64-bit arithmetic modulo 2**64.

``prefix`` gives S with S[i] the hash of the first i items, each times a power of an odd base. The hash of items [a, b)
is (S[b] - S[a]) * base**-a, mixed, and so depends on the items only.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: The bytes 0x20 and 0x09 to 0x0D separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16) if have is None else max(n, 2 * len(have))
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(items: np.ndarray) -> np.ndarray:
    out = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum((items.astype(np.uint64) + np.uint64(1)) * _pow(BASE, len(items)), out=out[1:])
    return out


def spans(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the item ranges [a, b)."""
    return mix((s[b] - s[a]) * _pow(INV, len(s))[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(s: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ranges of k items, by their start."""
    n = len(s) - k
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mix((s[k:] - s[:n]) * _pow(INV, n) + np.uint64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and word offsets by document; words never cross documents."""
    n = len(raw)
    inside = ~SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    if n:
        last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    return spans(prefix(LOWER[raw] if lower else raw), starts, ends)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest of each w neighbours, the last of equal ones, by the window's start."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at, have = x.copy(), np.arange(len(x)), 1
    while have < w:
        step = min(have, w - have)
        m = len(best) - step
        right = best[step:] <= best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.where(right, best[step:], best[:m])
        have += step
    return at[:n]
