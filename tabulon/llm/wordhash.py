"""64-bit hashes of words and word windows of a text, computed on whole arrays.

A byte string's hash is ``sum(R[b_i] * B**i)`` modulo 2**64 with random odd ``B`` and random ``R``, taken from running sums
and then mixed; it does not depend on the process, so workers agree on it.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
BASE = int(_RNG.integers(1 << 62)) * 4 + 3
_TABLE = _RNG.integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CHUNK = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.ones(_CHUNK + 1, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out)


_POWER, _INVERSE = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit integer hash (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table``'s base to the power of each n (ascending), for any n below 2**32."""
    if not len(n) or n[-1] <= _CHUNK:
        return table[n]
    low, high = table[n % _CHUNK], n // _CHUNK
    steps = np.ones(int(high[-1]) + 1, np.uint64)
    steps[1:] = table[_CHUNK]
    return low * np.cumprod(steps)[high]


def first_powers(n: int, table: np.ndarray) -> np.ndarray:
    """Powers 0 to n - 1."""
    return table[:n] if n <= len(table) else power(np.arange(n), table)


def running(raw: np.ndarray) -> np.ndarray:
    """Running sums of the hash of bytes, or of 64-bit words: entry i covers the first i."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_TABLE[raw] if raw.dtype == np.uint8 else raw) * first_powers(len(raw), _POWER), out=out[1:])
    return out


def pieces(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges ``[start, end)`` (ascending) of a sequence with running sums ``sums``."""
    return mix((sums[ends] - sums[starts]) * power(starts, _INVERSE) + (ends - starts).astype(np.uint64))


def all_pieces(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every range of n, by start."""
    count = max(0, len(sums) - n)
    x = (sums[n:] - sums[:count]) * first_powers(count, _INVERSE)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    black = np.zeros(len(raw) + 2, bool)
    black[1:-1] = ~WHITE[raw]
    edges = np.flatnonzero(black[1:] != black[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """Hash of each word of a text, with A to Z in lower case if asked."""
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = LOWER[raw]
    starts, ends = word_bounds(raw)
    return pieces(running(raw), starts, ends)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n words; none if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - n + 1 + i]
    return mix(out)
