"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, Newton leaf values, level-wise trees of fixed depth stored as heaps."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, shrink: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.shrink = rounds, depth, rate, bins, least, shrink
        self.cuts: list[np.ndarray] = []
        self.base, self.trees = 0.0, []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if len(self.cuts) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> BoostedTrees:
        """With no rows or one class the model gives that class's share (0.5 without rows). Rows count by their weights (1 each
        by default)."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not len(y):
            return self
        each = np.ones(len(y)) if weights is None else np.asarray(weights, float) * len(y) / np.sum(weights)
        share = ((each * y).sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        if y.min() == y.max():
            return self
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        self.cuts = [c[c > col.min()] if len(c) else c for c, col in zip(self.cuts, x.T, strict=True)]
        b, score = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, leaf_of = self._tree(b, each * (p - y), each * p * (1 - p))
            self.trees.append(tree)
            score += tree[2][leaf_of]
        return self

    def _tree(self, b, gradient, hessian):
        nodes = (1 << self.depth) - 1
        feature, threshold = np.zeros(nodes, int), np.full(nodes, self.bins, int)  # by default everything goes left
        at, k = np.zeros(len(b), int), self.bins + 1
        for level in range(self.depth):
            first, n = (1 << level) - 1, 1 << level
            best = np.zeros(n)
            for j in range(b.shape[1]):
                cell = (at - first) * k + b[:, j]
                g, h, c = (np.cumsum(np.bincount(cell, w, n * k).reshape(n, k), axis=1) for w in (gradient, hessian, None))
                gain = g**2 / (h + self.shrink) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.shrink) - g[:, -1:] ** 2 / (h[:, -1:] + self.shrink)
                gain[(c < self.least) | (c[:, -1:] - c < self.least)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(n), top] > best + 1e-9
                best[better] = gain[np.arange(n), top][better]
                feature[first : first + n][better], threshold[first : first + n][better] = j, top[better]
            at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > threshold[at])
        leaf = at - nodes
        g, h = np.bincount(leaf, gradient, nodes + 1), np.bincount(leaf, hessian, nodes + 1)
        return (feature, threshold, -self.rate * g / (h + self.shrink)), leaf

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        if self.trees:
            b = self._binned(x)
            for feature, threshold, value in self.trees:
                at = np.zeros(len(x), int)
                for _ in range(self.depth):
                    at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > threshold[at])
                score += value[at - len(feature)]
        return 1 / (1 + np.exp(-score))
