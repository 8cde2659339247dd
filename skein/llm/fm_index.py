"""An FM-index over integer sequences in numpy: suffix array, wavelet matrix, backward search and location."""

from __future__ import annotations

import numpy as np


def refine(order: np.ndarray, rank: np.ndarray, starts: np.ndarray, depth: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Prefix doubling: order is sorted by the first `depth` symbols, rank is each position's first slot in its
    group, starts marks the slots that begin groups. Only groups of two or more are sorted again. Stops when all
    groups are single, or after `limit` symbols."""
    n = len(order)
    while limit is None or depth < limit:
        ends = np.r_[starts[1:], True]
        open_slots = np.flatnonzero(~(starts & ends))
        if not len(open_slots):
            break
        act = order[open_slots]
        to = act + depth
        key = np.full(len(act), -1, np.int64)
        inside = to < n
        key[inside] = rank[to[inside]]
        own = rank[act]
        by = np.lexsort((key, own))
        act, key, own = act[by], key[by], own[by]
        order[open_slots] = act
        new = np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])]
        starts[open_slots] |= new
        rank[act] = open_slots[np.maximum.accumulate(np.where(new, np.arange(len(act)), 0))]
        depth *= 2
    return order, rank


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of symbols >= 1 and separators 0, which sort first and are told apart by position."""
    n = len(text)
    key = np.where(text > 0, text.astype(np.int64) + n, np.arange(n))
    order = np.argsort(key, kind="stable")
    starts = np.r_[True, key[order][1:] != key[order][:-1]][:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    return refine(order, rank, starts, 1)[0]


class Bits:
    """A packed bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.r_[bits, np.zeros(-len(bits) % 64 + 64, bool)], bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        part = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(part)


class Wavelet:
    """Symbol ranks over a sequence; one bit vector for each bit of the symbols."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            bit = (seq >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(len(seq) - bit.sum())))
            seq = np.r_[seq[~bit], seq[bit]]
        every = np.arange(sigma + 1)
        self.first = self._walk(every, np.zeros(len(every), np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(c >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        return self._walk(c, i) - self.first[c]


class FMIndex:
    """Over a sequence that ends with a separator."""

    def __init__(self, text: np.ndarray, sigma: int, step: int = 16):
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = np.where(order > 0, text[order - 1], 0)
        self.tree = Wavelet(self.bwt, sigma)
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma + 1))][: sigma + 1]
        # suffix positions are kept for every step-th one, and where a walk would leave its run
        kept = (order % step == 0) | (self.bwt == 0)
        self.kept, self.places = Bits(kept), order[kept]
        self.is_kept = kept

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of equally long patterns, one in each row."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            lo[live] = self.below[c] + self.tree.rank(c, lo[live])
            hi[live] = self.below[c] + self.tree.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to a kept one."""
        out, at, back = np.empty(len(rows), np.int64), rows.copy(), 0
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            done = self.is_kept[here]
            out[live[done]] = self.places[self.kept.ones(here[done])] + back
            live, here = live[~done], here[~done]
            c = self.bwt[here]
            at[live] = self.below[c] + self.tree.rank(c, here)
            back += 1
        return out
