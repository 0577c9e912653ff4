"""A compressed FM-index over integer sequences: wavelet matrix, rank directory, backward search.

The suffix order is exact to DEPTH symbols, enough for patterns of up to DEPTH; all
searches are vectorised over many patterns at once.
"""

from __future__ import annotations

import numpy as np

DEPTH = 8


class BitVector:
    """Bits packed in words of 64 with a running count per word."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros((self.size // 64 + 1) * 64, dtype=bool)
        padded[: self.size] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)
        self.ones = int(counts.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.planes, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level) & 1 == 1
            plane = BitVector(bits)
            self.planes.append(plane)
            self.zeros.append(plane.size - plane.ones)
            values = np.concatenate([values[~bits], values[bits]])

    def counts_before(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before lo and before hi."""
        start = np.zeros_like(lo)
        for plane, zeros, level in zip(self.planes, self.zeros, range(self.levels - 1, -1, -1)):
            one = (symbols >> level) & 1 == 1
            moved = []
            for at in (start, lo, hi):
                r = plane.rank1(at)
                moved.append(np.where(one, zeros + r, at - r))
            start, lo, hi = moved
        return lo - start, hi - start


class FMIndex:
    """Index of one sequence of symbols 1..sigma-1 in which 0 separates texts; the last symbol is 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        rank, span = text.astype(np.int64), 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: n - span] = rank[span:] + 1
            order = np.lexsort((after, rank)) if span == 1 else np.argsort(rank * (n + sigma + 2) + after, kind="stable")
            key_a, key_b = rank[order], after[order]
            fresh = np.concatenate([[0], (key_a[1:] != key_a[:-1]) | (key_b[1:] != key_b[:-1])]).astype(np.int64)
            dense = np.empty(n, dtype=np.int64)
            dense[order] = np.cumsum(fresh)
            rank, span = dense, span * 2
            if span >= DEPTH or fresh.sum() == n - 1:
                break
        self.suffixes = order
        self.first = np.searchsorted(text[order], np.arange(sigma + 1))
        self.matrix = WaveletMatrix(text[order - 1], sigma)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of equally long patterns (rows) by backward search, and symbols matched.

        A pattern whose range shrinks to one suffix is left at that suffix: it occurs
        nowhere else, and its matching statistic is the number of symbols before that.
        """
        lo, hi = self.first[patterns[:, -1]].copy(), self.first[patterns[:, -1] + 1].copy()
        matched = (hi - lo > 1).astype(np.int64)
        for step in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(hi - lo > 1)
            if not len(live):
                break
            symbols = patterns[live, step]
            a, b = self.matrix.counts_before(symbols, lo[live], hi[live])
            lo[live], hi[live] = self.first[symbols] + a, self.first[symbols] + b
            matched[live] += hi[live] - lo[live] > 1
        return lo, hi, matched
