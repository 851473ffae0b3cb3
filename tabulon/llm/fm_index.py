"""FM-index over a sequence of symbols, on arrays: suffix order, wavelet tree of the transform, backward search.

Queries run side by side: every step extends many patterns by one symbol to the left.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (symbols from 0), sorted by at least ``depth`` symbols, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    size = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:max(0, n - size)] = rank[size:] + 1
        key = rank * (rank.max(initial=0) + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step) - 1
        size *= 2
        if size >= depth or n == 0 or rank[order[-1]] == n - 1:
            return order


class WaveletTree:
    """Wavelet tree in level order (bits from the highest down, zeros before ones on each level), bit-packed, with the
    number of ones before each 64-bit block."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.n, self.levels = len(values), max(1, int(symbols - 1).bit_length())
        self.blocks, self.before, self.zeros = [], [], []
        now = values.astype(np.int64)
        for level in reversed(range(self.levels)):
            bit = (now >> level) & 1
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            b = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[:len(b)] = b
            block = packed.view("<u8")
            self.blocks.append(block)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(block).astype(np.int32))[:-1]]).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        # where each symbol's own run begins on the last level: place 0 taken down the tree, once for every symbol
        self.begin = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol[j]`` before place ``at[j]``, counted from where the symbol's own run begins."""
        return self._down(symbol, at.astype(np.int64)) - self.begin[symbol]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the places ``at`` of the sequence lie on the last level, along their symbols' paths."""
        for k in range(self.levels):
            ones = self._ones(k, at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        inside = self.blocks[level][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level][block] + np.bitwise_count(inside)


class FMIndex:
    """Index of ``text``; ``owner`` gives each place's document, and a pattern counts as found only if it starts in a
    document below the query's own."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int):
        symbols = int(text.max(initial=0)) + 1
        order = suffix_order(text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        # the transform: the symbol before each suffix; the text's own end wraps to its last symbol
        self.tree = WaveletTree(text[order - 1], symbols)
        self.least = [owner[order].astype(np.int32)]
        width = 1
        while 2 * width <= len(order):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.n = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns after one more symbol on their left.  An empty pattern's range needs no rank."""
        begun = np.flatnonzero((low > 0) | (high < self.n))
        lo, hi = self.first[symbol], self.first[symbol + 1]
        if len(begun):
            s = symbol[begun]
            both = self.tree.rank(np.concatenate([s, s]), np.concatenate([low[begun], high[begun]]))
            lo[begun], hi[begun] = self.first[s] + both[:len(s)], self.first[s] + both[len(s):]
        return lo, hi

    def owner_below(self, low: np.ndarray, high: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether a suffix of each range lies in a document below ``own``."""
        out = np.zeros(len(low), bool)
        size = high - low
        level = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
        for k in np.unique(level[size > 0]):
            at = np.flatnonzero((level == k) & (size > 0))
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)]) < own[at]
        return out


def matched_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, stops: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """Flags of the places in ``text`` where ``length`` symbols start, inside one query ``[start, stop)``, that also start in
    a document below the query's.

    For a right end, backward search gives the longest match to the left (the matching statistic of that end); all windows
    inside it match.  Where it stops at a place q, a short string from q is sought that is not found either; every window
    that holds that string fails as well, so the next right end lies before the string's last symbol.  All queries take
    their steps together.
    """
    flag = np.zeros(len(text) + 1, np.int32)  # steps of the mask
    end, left = stops.astype(np.int64).copy(), stops.astype(np.int64).copy()
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), index.n, np.int64)
    probe = np.zeros(len(starts), np.int64)   # 0: scan from a right end; else length of the string sought from q
    q = np.zeros(len(starts), np.int64)
    live = np.flatnonzero(stops - starts >= length)
    while len(live):
        symbol = text[left[live] - 1]
        lo, hi = index.extend(symbol, low[live], high[live])
        found = index.owner_below(lo, hi, own[live])
        go, no = live[found], live[~found]
        low[go], high[go] = lo[found], hi[found]
        left[go] -= 1
        scan, seek = probe[go] == 0, probe[go] > 0
        done = go[scan & (left[go] == starts[go])]
        _mark(flag, left[done], end[done], length)
        again = go[seek & (left[go] == q[go])]    # the string from q is found: seek a longer one
        probe[again] = np.minimum(2 * probe[again], end[again] - q[again])
        left[again] = q[again] + probe[again]
        miss = no[probe[no] == 0]
        _mark(flag, left[miss], end[miss], length)
        q[miss] = left[miss] - 1
        told = no[probe[no] > 0]                  # not found: windows end before its last symbol
        end[told] = q[told] + probe[told] - 1
        probe[told] = 0
        left[told] = end[told]
        probe[miss] = 1
        left[miss] = q[miss] + 1
        fresh = np.concatenate([again, told, miss])
        low[fresh], high[fresh] = 0, index.n
        over = np.zeros(len(starts), bool)
        over[done] = True
        over[told] = end[told] - starts[told] < length
        # after a miss at q, windows that could still match end before q's string and start before q
        over[miss] = q[miss] + 1 - starts[miss] < 1
        live = live[~over[live]]
    return np.cumsum(flag[:-1]) > 0


def _mark(flag: np.ndarray, left: np.ndarray, end: np.ndarray, length: int) -> None:
    ok = end - left >= length
    np.add.at(flag, left[ok], 1)
    np.add.at(flag, end[ok] - length + 1, -1)
