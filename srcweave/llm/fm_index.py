"""An FM-index over a sequence of word numbers: suffix order, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np

from srcweave.llm.text_arrays import ragged

#: Every so many positions of the sequence are kept in the index.
SAMPLE = 16


def suffix_order(symbols: np.ndarray, width: int) -> np.ndarray:
    """Starts of the suffixes in order.

    0 is a separator (the last symbol is one); a suffix is compared up to its first
    separator, earlier separators first, so ties end with the stretch that they stand in.
    ``width`` is the number of bits of a symbol.
    """
    n, take = len(symbols), max(1, min(16, 40 // width))
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    padded = np.concatenate((symbols, np.zeros(take, symbols.dtype))).astype(np.int64)
    for j in range(take):
        here = np.where(open_, padded[j : j + n], 0)
        key = key << width | here
        open_ &= here > 0
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    new |= ~open_[order]  # a separator was met: equal ones go by position
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~new
    tied[:-1] |= tied[1:]
    rows, depth = np.flatnonzero(tied), take
    while len(rows):
        at = order[rows]
        key = rank[at] * (n + 1) + rank[at + depth]
        by = np.argsort(key, kind="stable")
        order[rows] = at = at[by]
        key = key[by]
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        tied = ~new
        tied[:-1] |= tied[1:]
        rows, depth = rows[tied], 2 * depth
    return order


class WaveletMatrix:
    """Counts of a symbol before a place, in one step for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.ones, self.zeros = [], []
        row = symbols
        for bit in range(width - 1, -1, -1):
            set_ = (row >> bit & 1).astype(bool)
            ones = np.zeros(len(row) + 1, np.int32)
            np.cumsum(set_, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(row) - int(ones[-1]))
            row = np.concatenate((row[~set_], row[set_]))
        self.width = width

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        first = np.zeros_like(place)
        for level in range(self.width):
            set_ = (symbol >> (self.width - 1 - level) & 1).astype(bool)
            ones, zeros = self.ones[level], self.zeros[level]
            a, b = ones[first].astype(np.int64), ones[place].astype(np.int64)
            first = np.where(set_, zeros + a, first - a)
            place = np.where(set_, zeros + b, place - b)
        return place - first


class FMIndex:
    """Find phrases in a sequence of symbols (0 separates stretches)."""

    def __init__(self, symbols: np.ndarray, top: int):
        symbols = np.concatenate((symbols, [0])).astype(np.int64)
        width = max(1, int(top).bit_length())
        order = suffix_order(symbols, width)
        before = symbols[order - 1]
        before[order == 0] = 0
        self.before, self.n = before, len(symbols)
        self.tree = WaveletMatrix(before, width)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        self.sampled = (order % SAMPLE == 0) | (before == 0)
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def _step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.tree.rank(symbol, place)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes that begin with each phrase.

        Phrases are the rows of a matrix, aligned to its right side.
        """
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for j in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= j) & (low < high))
            symbol = phrases[live, -j]
            low[live], high[live] = self._step(symbol, low[live]), self._step(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of the suffix in each row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.sampled[rows])
        while len(walk):
            at = rows[walk]
            rows[walk] = self._step(self.before[at], at)
            steps[walk] += 1
            walk = walk[~self.sampled[rows[walk]]]
        return self.samples[self.sample_no[rows]] + steps

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the phrases found and the positions where they begin."""
        low, high = self.search(phrases, lengths)
        counts = np.maximum(high - low, 0)
        return np.repeat(np.arange(len(phrases)), counts), self.locate(ragged(low, counts))
