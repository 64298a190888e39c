"""FM-index over sequences of words: a wavelet matrix of bit vectors, and backward search for many patterns at once.

Suffixes are sorted by their first ``DEPTH`` words only. That orders every pattern of up to ``DEPTH`` words, and a
backward step from a pattern of fewer words counts suffixes that are ordered by those words, so searches of such
lengths are exact.
"""

from __future__ import annotations

import numpy as np

DEPTH, SEED = 16, 8
_U = np.uint64


class WaveletMatrix:
    """``rank(symbol, i)``: occurrences of a symbol before position i, a bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        count = len(symbols)
        for bit in reversed(range(max(1, int(top).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            padded = np.zeros(-(-(count + 1) // 64) * 64, bool)
            padded[:count] = ones
            words = np.packbits(padded, bitorder="little").view(_U)
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words)[:-1], out=before[1:])
            self.levels.append((bit, words, before, count - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbols: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """For each array of positions: the ranks, all from a shared origin that grows with the symbol alone."""
        at = list(positions)
        for bit, words, before, zeros in self.levels:
            set_ = (symbols >> bit & 1).astype(bool)
            for k, i in enumerate(at):
                ones = before[i >> 6] + np.bitwise_count(words[i >> 6] & ((_U(1) << (i & 63).astype(_U)) - _U(1)))
                at[k] = np.where(set_, zeros + ones, i - ones)
        return at


class FMIndex:
    """Index of ``line``, a line of positive symbols in which 0 parts the sequences."""

    def __init__(self, line: np.ndarray):
        count = len(line)
        ranks, step = line.astype(np.int64), 1
        self.seeds = None
        while step < DEPTH:
            after = np.zeros(count, np.int64)
            after[: count - step] = ranks[step:] + 1
            keys = ranks * (int(ranks.max(initial=0)) + 2) + after
            order = np.argsort(keys, kind="stable")
            sorted_ = keys[order]
            turns = np.ones(count, bool)
            turns[1:] = sorted_[1:] != sorted_[:-1]
            # A suffix is named by the first place of its equals, so a name is also where an interval begins.
            ranks = np.empty(count, np.int64)
            starts = np.flatnonzero(turns)
            ranks[order] = np.repeat(starts, np.diff(np.append(starts, count)))
            step *= 2
            if step == SEED:
                self.seeds = ranks
                ends = np.empty(count, np.int64)
                ends[starts] = np.append(starts, count)[1:]
                self.seed_ends = ends
        self.suffixes = order
        self.matrix = WaveletMatrix(line[order - 1], int(line.max(initial=0)))
        # Where the suffixes of each symbol begin, less the origin of its ranks.
        self.first = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=int(line.max(initial=0)) + 1))])[:-1]
        symbols = np.arange(len(self.first))
        self.first = self.first - self.matrix.rank(symbols, np.zeros(len(symbols), np.int64))[0]
        self.line = line

    def intervals(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns ``line[start:start + size]``, ``SEED`` <= size <= ``DEPTH``, without a 0.

        The last ``SEED`` words are looked up, as a table of short patterns, the others are taken one by one backwards.
        """
        at = starts + size - SEED
        low = self.seeds[at]
        high = self.seed_ends[low]
        for back in range(1, size - SEED + 1):
            symbols = self.line[at - back]
            low, high = self.matrix.rank(symbols, low, high)
            low, high = low + self.first[symbols], high + self.first[symbols]
        return low, high


def least_in(intervals: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
    """Smallest value in each interval; intervals are equal or apart."""
    low, high = intervals
    if not len(low):
        return np.zeros(0, values.dtype)
    ends = np.zeros(len(values) + 1, np.int64)
    ends[low] = high
    starts = np.flatnonzero(ends)
    cuts = np.stack([starts, ends[starts]], axis=1).ravel()
    least = np.minimum.reduceat(np.append(values, values[-1]), cuts)[::2]
    return least[np.searchsorted(starts, low)]
