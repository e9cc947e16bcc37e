"""FM-index over a sequence of word numbers: wavelet matrix, backward search, sampled locate.

Everything is vectorised over many patterns or rows at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of seq in the order of their suffixes, by prefix doubling.

    Each round sorts only the positions whose rank isn't yet unique. Sequences that end in symbols
    of their own (see FMIndex) compare no further than those.
    """
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    sa = np.argsort(seq, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first = np.concatenate([[True], seq[sa][1:] != seq[sa][:-1]])
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    width = 1
    slots = _tied(first)
    while len(slots):
        at = sa[slots]
        group = rank[at]
        nxt = rank[np.minimum(at + width, n)]
        order = np.lexsort((nxt, group))
        at, group, nxt = at[order], group[order], nxt[order]
        sa[slots] = at
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        keep = _tied(head)
        slots = slots[keep]
        width *= 2
    return sa


def _tied(head: np.ndarray) -> np.ndarray:
    """Indices of entries that share their group with another one; head marks where groups begin."""
    alone = head & np.concatenate([head[1:], [True]])
    return np.flatnonzero(~alone)


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(-n % 64 + 64, np.uint8)]), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.ones = int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position of i."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << r) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Rank and access over a sequence of small integers, one bit vector a level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = ((seq >> shift) & 1).astype(np.uint8)
            bits = Bits(bit)
            self.levels.append((shift, bits, len(seq) - bits.ones))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            rl, rh = bits.rank1(lo), bits.rank1(hi)
            lo = np.where(one, zeros + rl, lo - rl)
            hi = np.where(one, zeros + rh, hi - rh)
        return hi - lo

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before there."""
        symbol, lo, hi = np.zeros_like(i), np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            one = bits.get(hi).astype(bool)
            symbol |= one.astype(symbol.dtype) << shift
            rl, rh = bits.rank1(lo), bits.rank1(hi)
            lo = np.where(one, zeros + rl, lo - rl)
            hi = np.where(one, zeros + rh, hi - rh)
        return symbol, hi - lo


class FMIndex:
    """Index of one shard: several sequences of word numbers (from 1), none crossed by a match."""

    def __init__(self, runs: list[np.ndarray], symbols: int, sample: int = 8):
        """symbols: one more than the largest word number; every sample-th position is kept."""
        lengths = np.array([len(r) for r in runs], np.int64)
        self.length = int(lengths.sum()) + len(runs)
        seq = np.zeros(self.length, np.int64)
        ends = np.cumsum(lengths + 1) - 1
        body = np.ones(self.length, bool)
        body[ends] = False
        if len(runs):
            seq[body] = np.concatenate(runs)
        order = seq + len(runs)  # for sorting, each end mark is a symbol of its own
        order[ends] = np.arange(len(runs))
        sa = suffix_array(order)
        self.symbols = symbols
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.bwt = WaveletMatrix(seq[sa - 1], symbols)
        kept = (sa % sample == 0) | np.concatenate([[True], ~body[:-1]])[sa] if self.length else np.zeros(0, bool)
        self.kept, self.samples = Bits(kept.astype(np.uint8)), sa[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) that begin with each pattern. patterns: a matrix padded on the right;
        words the shard doesn't know are 0 or less, and such patterns have no rows."""
        n = len(patterns)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.length, np.int64)
        width = patterns.shape[1] if n else 0
        known = ((patterns > 0) | (np.arange(width) >= lengths[:, None])).all(axis=1) & (lengths > 0)
        hi[~known] = 0
        for back in range(1, width + 1):
            live = np.flatnonzero((hi > lo) & (lengths >= back))
            if not len(live):
                break
            c = patterns[live, lengths[live] - back]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.first[c] + both[: len(live)]
            hi[live] = self.first[c] + both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row, by walking back to the nearest kept one."""
        out = np.empty(len(rows), np.int64)
        todo, walked = np.arange(len(rows)), 0
        while len(todo):
            here = self.kept.get(rows).astype(bool)
            out[todo[here]] = self.samples[self.kept.rank1(rows[here])] + walked
            todo, rows = todo[~here], rows[~here]
            symbol, before = self.bwt.step(rows)
            rows = self.first[symbol] + before
            walked += 1
        return out
