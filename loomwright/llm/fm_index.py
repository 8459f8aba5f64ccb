"""A compressed full-text index (FM-index) over integer symbols, in numpy, built and searched in vectors.

Several texts are held in one index. Their separators are distinct and sort first, so no match crosses a text. The
last column is kept as a wavelet matrix of packed bits with block ranks; text positions are sampled every `step`
symbols and at each text's start, and found by walking back from the other rows.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Sorted suffixes of symbols (>= 1 but 0 at the separators) by prefix doubling over the suffixes still tied."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    m = len(separators)
    first = symbols.astype(np.int64) + m
    first[separators] = np.arange(m)
    bits = int(first.max()).bit_length()
    pack = max(1, 62 // max(bits, 1))
    key = first.copy()
    for j in range(1, pack):
        key <<= bits
        key[: n - j] |= first[j:] if j < n else 0
    # what follows a separator doesn't matter: separators differ already
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    depth = pack
    end = np.append(new[1:], True)
    tied = np.flatnonzero(~(new & end))
    while len(tied) and depth < n:
        at = sa[tied]
        nxt = at + depth
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        group = rank[at]
        order = np.lexsort((second, group))
        at, group, second = at[order], group[order], second[order]
        sa[tied] = at
        changed = np.ones(len(at), bool)
        changed[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        begin = tied[np.maximum.accumulate(np.where(changed, np.arange(len(at)), 0))]
        rank[at] = begin
        last = np.append(changed[1:], True)
        tied = tied[~(changed & last)]
        depth *= 2
    return sa


class Bits:
    """Packed bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.append(bits, np.zeros((-n) % 64 + 64, bits.dtype)).astype(np.uint8), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.uint32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:], dtype=np.uint32)

    def rank(self, pos: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = pos >> 6
        mask = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & mask)

    def get(self, pos: np.ndarray) -> np.ndarray:
        return (self.words[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Wavelet matrix: rank of any symbol before any position in as many steps as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(max(sigma - 1, 1)).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        s = symbols
        for k in range(self.levels - 1, -1, -1):
            b = ((s >> k) & 1).astype(bool)
            self.bits.append(Bits(b))
            self.zeros.append(int(len(b) - b.sum()))
            s = np.concatenate((s[~b], s[b]))
        self.start = self._walk(np.arange(1 << self.levels, dtype=np.int64), np.zeros(1 << self.levels, np.int64))

    def _walk(self, c: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self.bits[k].rank(pos)
            pos = np.where((c >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, pos - ones)
        return pos

    def rank(self, c: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return self._walk(c, pos) - self.start[c]

    def access(self, pos: np.ndarray) -> np.ndarray:
        c = np.zeros(len(pos), np.int64)
        for k in range(self.levels):
            b = self.bits[k].get(pos).astype(np.int64)
            ones = self.bits[k].rank(pos)
            pos = np.where(b, self.zeros[k] + ones, pos - ones)
            c = (c << 1) | b
        return c


class FMIndex:
    def __init__(self, texts: list[np.ndarray], step: int = 16):
        """texts: arrays of symbols >= 0 of any range."""
        self.lengths = np.array([len(t) for t in texts], np.int64)
        whole = np.concatenate([*[np.append(t, -1) for t in texts]]) if texts else np.zeros(0, np.int64)
        seps = np.flatnonzero(whole == -1)
        self.alphabet = np.unique(whole[whole >= 0])
        dense = np.searchsorted(self.alphabet, whole) + 1
        dense[seps] = 0
        self.n, self.starts = len(dense), seps - self.lengths
        sigma = len(self.alphabet) + 1
        sa = suffix_array(dense, seps)
        before = np.where(sa > 0, dense[sa - 1], 0) if self.n else dense
        self.wavelet = Wavelet(before, sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(dense, minlength=sigma)))).astype(np.int64)
        sampled = sa % step == 0
        sampled |= before == 0
        self.marks, self.samples = Bits(sampled), sa[sampled]

    def encode(self, symbols: np.ndarray) -> np.ndarray:
        """Own ids of symbols; 0 where the index doesn't hold the symbol."""
        if not len(self.alphabet):
            return np.zeros(len(symbols), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at + 1, 0)

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges of c + pattern, for ranges of patterns; empty for c = 0."""
        both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((lo, hi))) + np.concatenate((self.first[c],) * 2)
        lo2, hi2 = both[: len(c)], both[len(c) :]
        none = c == 0
        return np.where(none, 0, lo2), np.where(none, 0, hi2)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, a matrix of own ids with one pattern a row; equal endings are searched once."""
        rows, width = patterns.shape
        lo, hi = np.zeros(rows, np.int64), np.full(rows, self.n, np.int64)
        alive = np.arange(rows)
        if self.n == 0 or width == 0:
            return lo, hi * 0
        tail = min(3, width)
        code = np.zeros(rows, np.int64)
        for k in range(tail):
            code = code * len(self.first) + patterns[:, width - 1 - k]
        _, one, back = np.unique(code, return_index=True, return_inverse=True)
        l1, h1 = np.zeros(len(one), np.int64), np.full(len(one), self.n, np.int64)
        for k in range(tail):
            l1, h1 = self.extend(l1, h1, patterns[one, width - 1 - k])
            h1 = np.maximum(l1, h1)
        lo, hi = l1[back], h1[back]
        alive = alive[hi > lo]
        for k in range(tail, width):
            if not len(alive):
                break
            lo[alive], hi[alive] = self.extend(lo[alive], hi[alive], patterns[alive, width - 1 - k])
            alive = alive[hi[alive] > lo[alive]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the concatenation of the suffixes in these rows."""
        out = np.full(len(rows), -1, np.int64)
        todo, row, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.marks.get(row).astype(bool)
            out[todo[hit]] = self.samples[self.marks.rank(row[hit])] + walked
            todo, row = todo[~hit], row[~hit]
            if len(todo):
                c = self.wavelet.access(row)
                row = self.first[c] + self.wavelet.rank(c, row)
            walked += 1
        return out

    def text_of(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, offset in it) of positions."""
        t = np.searchsorted(self.starts, positions, side="right") - 1
        return t, positions - self.starts[t]

    def maximal_matches(self, texts: list[np.ndarray], least: int, segment: int = 2_000, cells: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, length, lo, hi) of the greedy right-to-left maximal matches of at least `least` own ids.

        Texts go backward together, one symbol a round; a text whose range becomes empty closes its match there and
        begins the next one at the same symbol. Texts longer than a segment are searched in segments, at whose borders
        a match ends; segments of like length share a batch of at most `cells` symbols.
        """
        parts = [(i, k, t[k : k + segment]) for i, t in enumerate(texts) for k in range(0, len(t), segment)]
        parts.sort(key=lambda p: len(p[2]))
        found, a = [], 0
        while a < len(parts):
            b = a + 1
            while b < len(parts) and (b + 1 - a) * len(parts[b][2]) <= cells:
                b += 1
            at, start, *rest = self._matches([p[2] for p in parts[a:b]], least)
            no, base = np.array([p[0] for p in parts[a:b]], np.int64), np.array([p[1] for p in parts[a:b]], np.int64)
            found.append((no[at], start + base[at], *rest))
            a = b
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(5))  # type: ignore[return-value]
        return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]

    def _matches(self, texts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m = len(texts)
        pos = np.array([len(t) for t in texts], np.int64)
        size = int(pos.max()) if m else 0
        pad = np.zeros((m, size + 1), np.int64)
        for i, t in enumerate(texts):
            pad[i, : len(t)] = t
        lo, hi, length = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.zeros(m, np.int64)
        found: list[tuple] = []
        live = np.flatnonzero(pos > 0)
        while len(live):
            c = pad[live, pos[live] - 1]
            l2, h2 = self.extend(lo[live], hi[live], c)
            ok = h2 > l2
            stop = live[~ok]
            keep = stop[length[stop] >= least]
            if len(keep):
                found.append((keep, pos[keep].copy(), length[keep].copy(), lo[keep].copy(), hi[keep].copy()))
            skip = stop[length[stop] == 0]
            pos[skip] -= 1  # a symbol that the index doesn't hold
            lo[stop], hi[stop], length[stop] = 0, self.n, 0
            go = live[ok]
            lo[go], hi[go] = l2[ok], h2[ok]
            length[go] += 1
            pos[go] -= 1
            done = live[pos[live] == 0]
            keep = done[length[done] >= least]
            if len(keep):
                found.append((keep, pos[keep].copy(), length[keep].copy(), lo[keep].copy(), hi[keep].copy()))
            live = live[pos[live] > 0]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(5))  # type: ignore[return-value]
        return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]
