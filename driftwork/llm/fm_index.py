"""An FM-index over a sequence of symbols: backward search by wavelet-matrix ranks, occurrences by sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(first: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, given distinct or equal ranks of the first symbols (prefix doubling)."""
    n = len(first)
    rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sort = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(False, sort[1:] != sort[:-1]))
        rank = new
        if not n or rank[order[-1]] == n - 1:
            return order
        step *= 2


class Bits:
    """A bit vector with rank: packed words, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        count = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(count) - count

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet tree in its level-wise form: one bit vector for each bit of the symbols, zeros before ones."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.levels, self.zeros = [], []
        for b in range(self.depth - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position i."""
        lo = np.zeros_like(i)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            a, b = level.rank(lo), level.rank(i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def get(self, i: np.ndarray) -> np.ndarray:
        """The symbol at position i."""
        out = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit = level.get(i).astype(np.int64)
            ones = level.rank(i)
            out = out * 2 + bit
            i = np.where(bit == 1, zeros + ones, i - ones)
        return out


class FMIndex:
    """Over symbols 1..top; 0 parts independent runs and is never searched. sampled: every so many positions keep their place."""

    def __init__(self, symbols: np.ndarray, top: int, sampled: int = 16):
        symbols = np.append(symbols, 0)
        part = symbols == 0
        # each 0 is a symbol of its own in the order, so that no comparison goes beyond a run
        first = np.where(part, np.cumsum(part) - 1, symbols + part.sum())
        order = suffix_order(first)
        self.n = len(symbols)
        self.bwt = Wavelet(symbols[order - 1], top)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.kept = np.zeros(self.n, bool)
        self.kept[::sampled] = True
        self.kept[1:][part[:-1]] = True  # nothing is sought across a 0
        self.kept = self.kept[order]
        self.mark = Bits(self.kept)
        self.place = order[self.kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each phrase. phrases: a row each, filled from the left."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for k in range(phrases.shape[1] - 1, -1, -1):
            use = np.flatnonzero((k < lengths) & (hi > lo))
            c = phrases[use, k]
            lo[use] = self.start[c] + self.bwt.rank(c, lo[use])
            hi[use] = self.start[c] + self.bwt.rank(c, hi[use])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: back through the text until a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.kept[rows])
        while len(todo):
            c = self.bwt.get(rows[todo])
            rows[todo] = self.start[c] + self.bwt.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.kept[rows[todo]]]
        return self.place[self.mark.rank(rows)] + steps
