"""Gradient-boosted trees for a yes-or-no target, small enough to be sent to every worker."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth on binned features, fitted to the logistic loss by second-order steps."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 32):
        self.trees, self.depth, self.rate, self.ridge, self.bins = trees, depth, rate, ridge, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._binned(x)
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(mean / (1 - mean)))
        self.nodes: list[list[tuple[int, int]]] = []
        self.leaves: list[np.ndarray] = []
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = p - y, p * (1 - p)
            splits, at = [], np.zeros(len(y), np.int64)
            for level in range(self.depth):
                # one (feature, bin) for all nodes of a level keeps a tree an index into 2 ** depth leaves
                n, best = 1 << level, (-np.inf, 0, 0)
                for j, edges in enumerate(self.edges):
                    k = len(edges) + 1
                    if k < 2:
                        continue
                    g = np.bincount(at * k + binned[:, j], gradient, n * k).reshape(n, k).cumsum(1)
                    h = np.bincount(at * k + binned[:, j], weight, n * k).reshape(n, k).cumsum(1)
                    gain = (g[:, :-1] ** 2 / (h[:, :-1] + self.ridge) + (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + self.ridge)).sum(0)
                    if gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()))
                splits.append(best[1:])
                at = at * 2 + (binned[:, best[1]] > best[2])
            size = 1 << self.depth
            leaf = -self.rate * np.bincount(at, gradient, size) / (np.bincount(at, weight, size) + self.ridge)
            score += leaf[at]
            self.nodes.append(splits)
            self.leaves.append(leaf)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        score = np.full(len(x), self.start)
        for splits, leaf in zip(self.nodes, self.leaves):
            at = np.zeros(len(x), np.int64)
            for j, b in splits:
                at = at * 2 + (binned[:, j] > b)
            score += leaf[at]
        return 1 / (1 + np.exp(-score))
