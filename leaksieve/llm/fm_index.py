"""An FM-index over integer sequences: backward search through a wavelet matrix, many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes in order, or in order of their first ``depth`` symbols at least.

    Doubles the compared length each round; what lies beyond the end is smallest.
    """
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    k = 1
    while n > 1 and rank.max() < n and (depth is None or k < depth):
        key = rank * (n + 1)
        key[: n - k] += rank[k:] if k < n else 0
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        k *= 2
    return order


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        words = -(-len(bits) // 64) + 1
        packed = np.zeros(words * 8, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.zeros(words, np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)


class WaveletMatrix:
    """Symbols by bit, highest first; at each bit the zeros go before the ones."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for shift in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = (symbols >> shift) & 1
            ones = bit.astype(bool)
            self.levels.append((shift, Bits(bit.astype(np.uint8)), int((~ones).sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.first = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, i) - self.first[symbol]


class FMIndex:
    """Counts and locates patterns in a sequence of symbols below ``sigma``; 0 separates.

    ``depth`` bounds the pattern length (the suffixes are ordered that far only); then
    occurrences are found by ``suffixes`` instead of ``locate``. Without it, every
    ``sample``-th position is stored, and ``locate`` walks to the next one.
    """

    def __init__(self, seq: np.ndarray, sigma: int, depth: int | None = None, sample: int = 8):
        # inside, 0 is the end of the sequence and all symbols are one higher
        seq = np.concatenate([seq + 1, [0]]).astype(np.int64)
        self.suffixes = suffix_array(seq, depth)
        self.last = seq[self.suffixes - 1]
        self.tree = WaveletMatrix(self.last, sigma + 1)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma + 1))])
        if depth is None:
            marked = self.suffixes % sample == 0
            self.marks = Bits(marked.astype(np.uint8))
            self.is_marked = marked
            self.positions = self.suffixes[marked]
            del self.suffixes

    def _before(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.smaller[symbol] + self.tree.rank(symbol, i)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each pattern (a row, its symbols at the right end)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), len(self.last), np.int64)
        width = patterns.shape[1]
        for step in range(1, width + 1):
            on = np.flatnonzero((lengths >= step) & (lo < hi))
            if not len(on):
                break
            symbol = patterns[on, width - step] + 1
            lo[on], hi[on] = self._before(symbol, lo[on]), self._before(symbol, hi[on])
        return lo, np.maximum(lo, hi)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of longer patterns: a symbol put before each."""
        return self._before(symbols + 1, lo), self._before(symbols + 1, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The start of the suffix in each row: steps back until a stored position."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        on = np.arange(len(rows))
        while len(on):
            here = self.is_marked[rows[on]]
            done = on[here]
            out[done] = self.positions[self.marks.rank(rows[done])] + steps
            on = on[~here]
            rows[on] = self._before(self.last[rows[on]], rows[on])
            steps += 1
        return out
