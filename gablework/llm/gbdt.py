"""Gradient-boosted trees for a yes-or-no decision: logistic loss, quantile bins, small tables."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.base = 0.0
        # of each tree, of each node in heap order: column, threshold (go right above it), value; leaves have column -1
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        x, y = x.astype(np.float64), y.astype(np.float64)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            col, cut, val = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(len(y), np.int64)
            for k in range(2**self.depth - 1):
                here = node == k
                if here.sum() < 2:
                    continue
                best = self._split(binned[here], g[here], h[here])
                if best:
                    col[k], b = best
                    cut[k] = edges[col[k]][b]
                    node[here] = 2 * k + 1 + (x[here, col[k]] > cut[k])
            for k in np.unique(node):
                here = node == k
                val[k] = -self.rate * g[here].sum() / (h[here].sum() + self.l2)
            self.trees.append((col, cut, val))
            score += val[node]
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        total_g, total_h = g.sum(), h.sum()
        best, gain = None, 1e-6
        for j in range(b.shape[1]):
            n = int(b[:, j].max()) + 1
            if n < 2:
                continue
            left_g, left_h = np.cumsum(np.bincount(b[:, j], g, n))[:-1], np.cumsum(np.bincount(b[:, j], h, n))[:-1]
            s = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
            k = int(s.argmax())
            if s[k] > gain:
                best, gain = (j, k), s[k]
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of yes."""
        score = np.full(len(x), self.base)
        for col, cut, val in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                c = col[node]
                inner = c >= 0
                right = x[np.arange(len(x)), np.maximum(c, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            score += val[node]
        return 1 / (1 + np.exp(-score))
