"""A linear-chain conditional random field in numpy: hashed binary features, batched forward-backward and Viterbi."""

from __future__ import annotations

import zlib

import numpy as np


#: Clauses, padding included, that are decoded at once.
CELLS = 50_000


def hashed(names: list[str], dims: int) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) % dims for x in names], np.int64)


class CRF:
    def __init__(self, labels: list[str], dims: int = 1 << 13):
        self.labels, self.dims = labels, dims
        k = len(labels)
        self.w, self.t, self.b = np.zeros((dims, k)), np.zeros((k, k)), np.zeros((2, k))

    def _pad(self, seqs: list[list[np.ndarray]], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores (n, longest, labels) and lengths."""
        n, size = np.array([len(s) for s in seqs]), max(map(len, seqs))
        e = np.zeros((len(seqs), size, w.shape[1]))
        flat = [f for s in seqs for f in s]
        counts = np.array([len(f) for f in flat])
        idx = np.concatenate(flat) if len(flat) else np.zeros(0, np.int64)
        sums = np.add.reduceat(w[idx], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0)
        at = np.arange(size)[None, :] < n[:, None]
        e[at] = sums
        e[:, 0] += self.b[0]
        e[np.arange(len(seqs)), n - 1] += self.b[1]
        return e, n

    @staticmethod
    def _lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    def fit(self, seqs: list[list[np.ndarray]], tags: list[list[int]], rounds: int = 120, rate: float = 0.5, decay: float = 1e-4) -> "CRF":
        """AdaGrad on the mean log-likelihood; sequences are non-empty. Same data give the same weights."""
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))  # longest first: the sequences that reach a place come first
        seqs, tags = [seqs[i] for i in order], [tags[i] for i in order]
        k, total = len(self.labels), sum(map(len, seqs))
        flat = [f for s in seqs for f in s]
        rows = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        idx = np.concatenate(flat)
        params = [self.w, self.t, self.b]
        seen = [np.full_like(p, 1e-8) for p in params]
        n = np.array([len(s) for s in seqs])
        size = int(n.max())
        at = np.arange(size)[None, :] < n[:, None]
        reach, last, of = at.sum(0), n - 1, np.nonzero(at)[0]
        every = np.arange(len(seqs))
        y = np.zeros((len(seqs), size), np.int64)
        y[at] = [t for s in tags for t in s]
        gold = np.eye(k)[y]
        flat_gold = gold[at]
        for _ in range(rounds):
            e, _ = self._pad(seqs, self.w)
            f, b = np.zeros_like(e), np.zeros_like(e)
            f[:, 0] = e[:, 0]
            for j in range(1, size):
                m = reach[j]
                f[:m, j] = self._lse(f[:m, j - 1, :, None] + self.t[None], 1) + e[:m, j]
            for j in range(size - 2, -1, -1):
                m = reach[j + 1]
                b[:m, j] = self._lse(self.t[None] + (e[:m, j + 1] + b[:m, j + 1])[:, None, :], 2)
            z = self._lse(f[every, last], 1)
            d = flat_gold - np.exp(np.minimum(f[at] + b[at] - z[of, None], 0))
            gt = np.zeros_like(self.t)
            for j in range(1, size):
                m = reach[j]
                pair = np.exp(np.minimum(f[:m, j - 1, :, None] + self.t[None] + (e[:m, j] + b[:m, j])[:, None, :] - z[:m, None, None], 0))
                gt += np.einsum("na,nb->ab", gold[:m, j - 1], gold[:m, j]) - pair.sum(0)
            gw = np.zeros_like(self.w)
            for c in range(k):
                gw[:, c] = np.bincount(idx, weights=d[rows, c], minlength=self.dims)
            ends = np.cumsum(n) - 1
            gb = np.stack([d[ends - last].sum(0), d[ends].sum(0)])
            for prm, g, s in zip(params, (gw, gt, gb), seen):
                g = g / total - decay * prm
                s += g * g
                prm += rate * g / np.sqrt(s)
        return self

    def decode(self, seqs: list[list[np.ndarray]]) -> list[list[int]]:
        """The best tag sequence of each non-empty sequence."""
        out: list[list[int]] = [[] for _ in seqs]
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * len(seqs[order[b]]) <= CELLS:
                b += 1
            part, a = order[a:b], b
            e, n = self._pad([seqs[i] for i in part], self.w)
            size = e.shape[1]
            v, back = e[:, 0].copy(), np.zeros((len(part), size, e.shape[2]), np.int64)
            for j in range(1, size):
                s = v[:, :, None] + self.t[None]
                back[:, j] = s.argmax(1)
                v = np.where((j < n)[:, None], s.max(1) + e[:, j], v)
            tag = v.argmax(1)
            path = np.zeros((len(part), size), np.int64)
            for j in range(size - 1, -1, -1):
                inside = j < n
                path[:, j] = np.where(inside, tag, 0)
                tag = np.where(inside, back[np.arange(len(part)), j, tag] if j else tag, tag)
            for i, row, m in zip(part, path, n):
                out[i] = row[:m].tolist()
        return out
