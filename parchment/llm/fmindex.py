"""An FM-index over a sequence of small integers: wavelet matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of text in their order, by doubling the compared length until no two are equal."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, k = new, 2 * k
        if n < 2 or rank[order[-1]] == n - 1 or k >= 2 * n:
            return order


class WaveletMatrix:
    """The bits of a sequence of integers below sigma, highest first, each level ordered by the bits above it."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = []
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (values >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]), int(len(values) - ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often symbol stands among the first end values; both arrays of one length."""
        start = np.zeros_like(end)
        for bit, ones, zeros in self.levels:
            high = (symbol >> bit & 1).astype(bool)
            a, b = ones[start], ones[end]
            start, end = np.where(high, zeros + a, start - a), np.where(high, zeros + b, end - b)
        return end - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros_like(at)
        for bit, ones, zeros in self.levels:
            a = ones[at]
            high = ones[at + 1] > a
            found |= high.astype(at.dtype) << bit
            at = np.where(high, zeros + a, at - a)
        return found


class FMIndex:
    """Index of text (integers from 0 below sigma). Every SAMPLE-th position of the text is kept with its row."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, sigma: int):
        # a symbol of its own, smaller than all, ends the text, so that the last-to-first walk is one cycle
        text = np.concatenate([text.astype(np.int64) + 1, [0]])
        order = suffix_array(text)
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.bwt = WaveletMatrix(text[order - 1], sigma + 1)
        marked = order % self.SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern; patterns are rows, of which the first lengths count."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            todo = np.flatnonzero((lengths >= back) & (low < high))
            symbol = patterns[todo, lengths[todo] - back].astype(np.int64) + 1
            low[todo] = self.before[symbol] + self.bwt.rank(symbol, low[todo])
            high[todo] = self.before[symbol] + self.bwt.rank(symbol, high[todo])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of the suffixes in the given rows, by steps back to a sampled position."""
        found, steps, todo, at = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            hit = self.marks[at + 1] > self.marks[at]
            found[todo[hit]] = self.samples[self.marks[at[hit]]] + steps[todo[hit]]
            todo, at = todo[~hit], at[~hit]
            symbol = self.bwt.symbol(at)
            at = self.before[symbol] + self.bwt.rank(symbol, at)
            steps[todo] += 1
        return found
