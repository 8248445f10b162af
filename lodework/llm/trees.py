"""Gradient-boosted regression trees for two classes, in numpy: small enough to ship inside a task."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Logistic loss, second-order leaves, histogram splits. Fit once on the driver; predict anywhere."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.25
    bins: int = 32
    least: float = 1.0
    ridge: float = 1.0
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.bias = float(np.log(share / (1 - share)))
        self.edges = [self._edges(x[:, j]) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        score, self.trees = np.full(n, self.bias), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, leaf_of = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            score = score + tree[2][leaf_of]
        return self

    def _edges(self, column: np.ndarray) -> np.ndarray:
        values = np.unique(column)
        if len(values) > self.bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, self.bins)))
        return (values[1:] + values[:-1]) / 2

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """A complete tree of `depth` levels as (feature, threshold, leaf value); a node that can't split sends all left."""
        inner = 2**self.depth - 1
        feature, threshold, value = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(2**self.depth)
        node, width, size = np.zeros(len(g), dtype=np.int64), binned.shape[1], self.bins + 1
        used = [j for j in range(width) if len(self.edges[j])]
        columns, offset = binned[:, used], np.arange(len(used)) * size
        weights_g, weights_h = np.repeat(g, len(used)), np.repeat(h, len(used))
        limit = np.array([len(self.edges[j]) for j in used])
        for level in range(self.depth):
            first = 2**level - 1
            local, count = node - first, 2**level
            shape, at = (count, len(used), size), (local[:, None] * (len(used) * size) + offset + columns).ravel()
            gs = np.bincount(at, weights_g, count * len(used) * size).reshape(shape).cumsum(axis=2)
            hs = np.bincount(at, weights_h, count * len(used) * size).reshape(shape).cumsum(axis=2)
            all_g, all_h = gs[:, :, -1:], hs[:, :, -1:]
            ok = (hs >= self.least) & (all_h - hs >= self.least) & (np.arange(size) < limit[:, None])
            gain = gs**2 / (hs + self.ridge) + (all_g - gs) ** 2 / (all_h - hs + self.ridge) - all_g**2 / (all_h + self.ridge)
            gain = np.where(ok, gain, -1.0).reshape(count, -1)
            top = gain.argmax(axis=1)
            gain_of = gain[np.arange(count), top]
            best = np.stack([np.array(used)[top // size], top % size], axis=1)
            go = np.zeros(len(g), dtype=bool)
            for k in range(count):
                if gain_of[k] > 1e-9:
                    j, cut = best[k]
                    feature[first + k], threshold[first + k] = j, self.edges[j][cut]
                    mine = local == k
                    go[mine] = binned[mine, j] > cut
            node = 2 * node + 1 + go
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
        value[:] = -self.rate * gs / (hs + self.ridge)
        return (feature, threshold, value), leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class."""
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return total
