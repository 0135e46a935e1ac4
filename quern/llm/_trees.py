"""Histogram decision trees in numpy: boosted trees, a random forest and isotonic regression.

Fitting runs on the driver over a bounded feature sample; prediction is vectorised and runs inside Arrow batches.
"""

from __future__ import annotations

import numpy as np


class Binner:
    def __init__(self, x: np.ndarray, bins: int = 32):
        grid = np.linspace(0, 1, bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], grid)) for j in range(x.shape[1])]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)


class Tree:
    """Nodes as parallel arrays; a row goes left where its bin is <= cut."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []

    def _node(self, value: float) -> int:
        for a, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value)):
            a.append(v)
        return len(self.value) - 1

    def grow(self, xb, g, h, rows, depth, min_leaf, l2, rng, n_features) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        me = self._node(-gs / (hs + l2))
        if depth == 0 or len(rows) < 2 * min_leaf:
            return me
        best = (1e-9, -1, 0)
        for j in rng.permutation(xb.shape[1])[:n_features]:
            b = xb[rows, j]
            top = int(b.max()) + 1
            if top < 2:
                continue
            cg, ch, cn = (np.cumsum(np.bincount(b, weights=w, minlength=top))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = cg**2 / (ch + l2) + (gs - cg) ** 2 / (hs - ch + l2) - gs**2 / (hs + l2)
            gain[(cn < min_leaf) | (len(rows) - cn < min_leaf)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(j), k)
        if best[1] < 0:
            return me
        goes = xb[rows, best[1]] <= best[2]
        self.feature[me], self.cut[me] = best[1], best[2]
        self.left[me] = self.grow(xb, g, h, rows[goes], depth - 1, min_leaf, l2, rng, n_features)
        self.right[me] = self.grow(xb, g, h, rows[~goes], depth - 1, min_leaf, l2, rng, n_features)
        return me

    def freeze(self) -> Tree:
        for k in ("feature", "cut", "left", "right", "value"):
            setattr(self, k, np.array(getattr(self, k)))
        return self

    def predict(self, xb: np.ndarray) -> np.ndarray:
        at = np.zeros(len(xb), dtype=np.int64)
        rows = np.arange(len(xb))
        while len(rows):
            f = self.feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            if len(rows):
                here = at[rows]
                at[rows] = np.where(xb[rows, f] <= self.cut[here], self.left[here], self.right[here])
        return self.value[at]


class BoostedTrees:
    """Second-order gradient boosting of the logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, min_leaf: int = 5, l2: float = 1.0, seed: int = 7):
        self.n, self.depth, self.rate, self.min_leaf, self.l2, self.seed = trees, depth, rate, min_leaf, l2, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rng = np.random.default_rng(self.seed)
        self.binner = Binner(x)
        xb = self.binner(x)
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            t = Tree()
            t.grow(xb, p - y, p * (1 - p), np.arange(len(y)), self.depth, self.min_leaf, self.l2, rng, x.shape[1])
            self.trees.append(t.freeze())
            f = f + self.rate * t.predict(xb)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        xb = self.binner(x)
        return self.base + self.rate * sum((t.predict(xb) for t in self.trees), np.zeros(len(x)))


class Forest:
    """Random forest: bootstrap rows, random features at each split, mean of the leaves' label shares."""

    def __init__(self, trees: int = 40, depth: int = 9, min_leaf: int = 3, seed: int = 11):
        self.n, self.depth, self.min_leaf, self.seed = trees, depth, min_leaf, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.binner = Binner(x)
        xb = self.binner(x)
        per_split = max(1, round(x.shape[1] ** 0.5))
        self.trees = []
        for _ in range(self.n):
            rows = rng.integers(0, len(y), len(y))
            t = Tree()
            t.grow(xb, -y.astype(float), np.ones(len(y)), rows, self.depth, self.min_leaf, 1e-6, rng, per_split)
            self.trees.append(t.freeze())
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        xb = self.binner(x)
        return np.clip(sum((t.predict(xb) for t in self.trees), np.zeros(len(x))) / self.n, 0, 1)


class Isotonic:
    """Pool-adjacent-violators fit, evaluated by linear interpolation between block means."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []  # sum of y, weight, sum of s
        for a, b in zip(s[order], y[order], strict=True):
            if blocks and blocks[-1][3] == a:  # equal scores share a block
                blocks[-1][0] += b
                blocks[-1][1] += 1
                blocks[-1][2] += a
            else:
                blocks.append([float(b), 1.0, float(a), float(a)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                y1, w1, s1, last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + y1, blocks[-1][1] + w1, blocks[-1][2] + s1, last]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.array([b[0] / b[1] for b in blocks])
        return self

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(s, self.x, self.y), 0, 1)
