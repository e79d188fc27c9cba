"""Small gradient boosting of regression trees on logistic loss, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Boosted trees over at most 32 bins a feature; ``fit`` is deterministic."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8) -> None:
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 32)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(q, c, side="right") for q, c in zip(self.cuts, x.T, strict=True)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._leaf_values(tree, x)
        return self

    def _tree(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        rows = {0: np.arange(len(g))}
        for node in range(size):
            own = rows.pop(node, None)
            if own is None:
                continue
            value[node] = self.rate * g[own].sum() / (h[own].sum() + 1.0)
            if node >= 2**self.depth - 1 or len(own) < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            total_g, total_h = g[own].sum(), h[own].sum()
            whole = total_g**2 / (total_h + 1)
            for f in range(bins.shape[1]):
                n = len(self.cuts[f]) + 1
                if n < 2:
                    continue
                b = bins[own, f]
                left_g = np.cumsum(np.bincount(b, g[own], n))[:-1]
                left_h = np.cumsum(np.bincount(b, h[own], n))[:-1]
                count = np.cumsum(np.bincount(b, minlength=n))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - whole
                gain[(count < self.least) | (len(own) - count < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] >= 0:
                _, f, k = best
                feature[node], cut[node] = f, self.cuts[f][k]
                left = bins[own, f] <= k
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return feature, cut, value

    def _leaf_values(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] >= cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._leaf_values(tree, x)
        return 1 / (1 + np.exp(-score))
