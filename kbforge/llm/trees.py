"""Small histogram trees in numpy: Newton leaf values, optional monotonic constraints.

A tree is five flat arrays; leaves point at themselves, so scoring walks all rows
level by level without branches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray       # of each node; 0 for leaves
    threshold: np.ndarray     # a row goes left if its value is <= threshold
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


class Bins:
    """Quantile thresholds of each feature and the rows' bin numbers."""

    def __init__(self, x: np.ndarray, n_bins: int = 32):
        self.edges = []
        for f in range(x.shape[1]):
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1], method="lower"))
            if len(cuts) and cuts[-1] == x[:, f].max():
                cuts = cuts[:-1]
            self.edges.append(cuts)
        self.codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)


def grow(bins: Bins, grad: np.ndarray, hess: np.ndarray, depth: int, min_rows: int = 20, ridge: float = 1.0,
         monotone: dict[int, int] | None = None, features: np.ndarray | None = None,
         rows: np.ndarray | None = None) -> Tree:
    """A tree that lowers sum(grad * f + hess * f**2 / 2).

    ``monotone`` maps a feature to +1 (never falls as the feature grows) or -1:
    splits against it are refused and the middle of the two sides bounds all that
    hangs below each side.
    """
    monotone = monotone or {}
    features = np.arange(bins.codes.shape[1]) if features is None else features
    nodes: list[list] = []        # feature, threshold, left, right, value

    def leaf_value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        value = leaf_value(g, h, low, high)
        nodes.append([0, 0.0, at, at, value])
        if level == depth or len(rows) < 2 * min_rows:
            return at
        best = (1e-9, -1, -1, 0.0, 0.0)
        for f in features:
            edges = bins.edges[f]
            if not len(edges):
                continue
            codes = bins.codes[rows, f]
            gs = np.cumsum(np.bincount(codes, grad[rows], len(edges) + 1))[:-1]
            hs = np.cumsum(np.bincount(codes, hess[rows], len(edges) + 1))[:-1]
            ns = np.cumsum(np.bincount(codes, minlength=len(edges) + 1))[:-1]
            lv = np.clip(-gs / (hs + ridge), low, high)
            rv = np.clip(-(g - gs) / (h - hs + ridge), low, high)
            loss = lambda v, gg, hh: gg * v + 0.5 * (hh + ridge) * v * v
            gain = loss(value, g, h) - loss(lv, gs, hs) - loss(rv, g - gs, h - hs)
            gain[(ns < min_rows) | (len(rows) - ns < min_rows)] = -np.inf
            if f in monotone:
                gain[monotone[f] * (rv - lv) < 0] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), k, float(lv[k]), float(rv[k]))
        _, f, k, lv, rv = best
        if f < 0:
            return at
        goes_left = bins.codes[rows, f] <= k
        bounds = [(low, high), (low, high)]
        if f in monotone:
            mid = (lv + rv) / 2
            bounds = [(low, mid), (mid, high)] if monotone[f] > 0 else [(mid, high), (low, mid)]
        left = build(rows[goes_left], level + 1, *bounds[0])
        right = build(rows[~goes_left], level + 1, *bounds[1])
        nodes[at][:4] = [f, float(bins.edges[f][k]), left, right]
        return at

    build(np.arange(len(grad)) if rows is None else rows, 0, -np.inf, np.inf)
    cols = list(zip(*nodes, strict=True))
    return Tree(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4]), depth)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


@dataclass
class Boosted:
    """Gradient-boosted trees for a 0/1 label: start value and flat trees."""

    start: float
    trees: list[Tree]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for t in self.trees:
            z += t.score(x)
        return sigmoid(z)


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float = 0.2, seed: int = 7,
          monotone: dict[int, int] | None = None, row_share: float = 1.0, feature_share: float = 1.0,
          min_rows: int = 20) -> Boosted:
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(prior / (1 - prior)))
    bins, z, trees, rng = Bins(x), np.full(len(y), start), [], np.random.default_rng(seed)
    for _ in range(rounds):
        p = sigmoid(z)
        rows = np.flatnonzero(rng.random(len(y)) < row_share) if row_share < 1 else None
        features = (rng.permutation(x.shape[1])[:max(1, int(feature_share * x.shape[1]))]
                    if feature_share < 1 else None)
        tree = grow(bins, p - y, np.maximum(p * (1 - p), 1e-6), depth, min_rows, 1.0, monotone, features, rows)
        tree.value *= rate
        z += tree.score(x)
        trees.append(tree)
    return Boosted(start, trees)
