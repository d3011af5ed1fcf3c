"""Gradient-boosted trees with logistic loss on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Trees are lists of nodes (feature, edge, left, right, value); a node without a feature is a leaf."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 24
    least: int = 8
    start: float = 0.0
    nodes: list[list[tuple]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        z = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            tree: list[tuple] = []
            self._grow(tree, codes, edges, np.arange(len(y)), y - p, p * (1 - p), self.depth)
            self.nodes.append(tree)
            z += self._walk(tree, x)
        return self

    def _grow(self, tree: list, codes: np.ndarray, edges: list, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> int:
        at = len(tree)
        tree.append(None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0.0, None)
        if depth and len(rows) >= 2 * self.least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = codes[rows, f]
                left_g = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                n = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                gain[(n < self.least) | (len(rows) - n < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, float(e[k]), c <= k)
        if best[1] < 0:
            tree[at] = (-1, 0.0, 0, 0, float(self.rate * total_g / (total_h + 1)))
        else:
            left = self._grow(tree, codes, edges, rows[best[3]], g, h, depth - 1)
            right = self._grow(tree, codes, edges, rows[~best[3]], g, h, depth - 1)
            tree[at] = (best[1], best[2], left, right, 0.0)
        return at

    @staticmethod
    def _walk(tree: list, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            f, edge, left, right, value = tree[at]
            if f < 0:
                out[rows] = value
            else:
                low = x[rows, f] <= edge
                todo += [(left, rows[low]), (right, rows[~low])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for tree in self.nodes:
            z += self._walk(tree, x)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
