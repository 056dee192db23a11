"""Gradient boosted trees for a few dozen features, in numpy."""

from __future__ import annotations

import numpy as np

#: Trees between two looks at which rows may still matter.
STEP = 10


class BoostedTrees:
    """Logistic boosting with complete trees of fixed depth; splits at quantiles of the features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.25, cuts: int = 16, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.cuts, self.ridge = trees, depth, rate, cuts, ridge
        self.base = 0.0
        self.features = np.zeros((0, 2**depth - 1), np.int32)
        self.limits = np.zeros((0, 2**depth - 1))
        self.leaves = np.zeros((0, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, m = x.shape
        w = np.ones(n) if weight is None else weight
        share = min(max(float(np.average(y, weights=w)), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[1:-1])) for j in range(m)]
        # distinct values of small domains are cut between each other
        edges = [np.unique(x[:, j])[:-1] if len(np.unique(x[:, j])) <= self.cuts else e for j, e in enumerate(edges)]
        width = max((len(e) for e in edges), default=0) + 1
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        flat = bins + np.arange(m) * width
        inner, leaves = 2**self.depth - 1, 2**self.depth
        features, limits, values = [], [], []
        margin = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (y - p), w * (p * (1 - p) + 1e-6)
            node = np.zeros(n, int)
            f, c, b = np.zeros(inner, np.int32), np.full(inner, np.inf), np.full(inner, width)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(2**level):
                    at = np.flatnonzero(node == k)
                    if len(at) < 8:
                        continue
                    cell = flat[at].ravel()
                    gs = np.bincount(cell, np.repeat(g[at], m), m * width).reshape(m, width).cumsum(1)
                    hs = np.bincount(cell, np.repeat(h[at], m), m * width).reshape(m, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    j, cut = np.unravel_index(np.argmax(gain[:, :-1]), (m, width - 1))
                    if gain[j, cut] > 1e-6 and cut < len(edges[j]):
                        f[first + k], c[first + k], b[first + k] = j, edges[j][cut], cut
                place = first + node
                node = 2 * node + (bins[np.arange(n), f[place]] > b[place])
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            leaf = self.rate * gs / (hs + self.ridge)
            margin += leaf[node]
            features.append(f)
            limits.append(c)
            values.append(leaf)
        self.features, self.limits, self.leaves = np.array(features), np.array(limits), np.array(values)
        return self

    def predict(self, x: np.ndarray, least: float = 0.0) -> np.ndarray:
        """Probability of the positive class for every row; 0 where it is below ``least``, as soon as no further tree could change that."""
        if least > 0:
            return self._at_least(x, least)
        n = len(x)
        return 1 / (1 + np.exp(-self._add(x, np.full(n, self.base), slice(None))))

    def _add(self, x: np.ndarray, margin: np.ndarray, trees: slice) -> np.ndarray:
        """``margin`` and the leaves of these trees."""
        n, rows = len(x), np.arange(len(x))
        margin = margin.copy()
        columns = np.ascontiguousarray(x.T)
        right = np.empty((self.features.shape[1], n), np.int8)
        flat = right.reshape(-1)
        for f, c, leaf in zip(self.features[trees], self.limits[trees], self.leaves[trees]):
            for k, (j, limit) in enumerate(zip(f.tolist(), c.tolist())):
                np.greater(columns[j], limit, out=right[k], casting="unsafe")
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                node = 2 * node + flat[(node + (2**level - 1)) * n + rows]
            margin += leaf[node]
        return margin

    def _at_least(self, x: np.ndarray, least: float) -> np.ndarray:
        """Some trees at a time; rows that even the best leaves of the others leave below ``least`` drop out."""
        out, alive, margin = np.zeros(len(x)), np.arange(len(x)), np.full(len(x), self.base)
        best = np.append(self.leaves.max(1)[::-1].cumsum()[::-1], 0.0)
        needed = np.log(least / (1 - least)) - 1e-9
        for low in range(0, len(self.leaves), STEP):
            margin = self._add(x[alive], margin, slice(low, low + STEP))
            stay = margin + best[min(low + STEP, len(self.leaves))] >= needed
            alive, margin = alive[stay], margin[stay]
        p = 1 / (1 + np.exp(-margin))
        out[alive] = np.where(p >= least, p, 0.0)
        return out

    def one(self, x: np.ndarray) -> float:
        """Probability of a single row, all trees at a time."""
        trees, node = np.arange(len(self.leaves)), np.zeros(len(self.leaves), int)
        for level in range(self.depth):
            place = 2**level - 1 + node
            node = 2 * node + (x[self.features[trees, place]] > self.limits[trees, place])
        return float(1 / (1 + np.exp(-(self.base + self.leaves[trees, node].sum()))))
