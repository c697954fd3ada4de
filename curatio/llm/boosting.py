"""Gradient-boosted trees on dense features and isotonic calibration, in numpy.

For bounded training samples; scoring is vectorised over rows of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]   # (feature, threshold, leaf values) of complete trees
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.15, bins: int = 48,
        ridge: float = 2.0, least: float = 4.0) -> Boosted:
    """Logistic loss, second-order leaf values, splits at feature quantiles."""
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base, out = float(np.log(mean / (1 - mean))), []
    if not len(y) or y.min() == y.max():
        return Boosted(base, [], depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin, width = np.full(len(y), base), bins + 1
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-9)
            where = node - first
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = where * width + code[:, j]
                gs, hs = (np.bincount(cell, w, count * width).reshape(count, width).cumsum(axis=1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :len(e)], hs[:, :len(e)]
                gain = gl**2 / (hl + ridge) + (gt - gl)**2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(count), k] > best
                best[better] = gain[np.arange(count), k][better]
                feature[first:first + count][better] = j
                threshold[first:first + count][better] = e[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        cell = node - inner
        leaf = rate * np.bincount(cell, g, inner + 1) / (np.bincount(cell, h, inner + 1) + ridge)
        margin += leaf[cell]
        out.append((feature, threshold, leaf))
    return Boosted(base, out, depth)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (knots, values), to be read with ``np.interp``; values in 0..1."""
    if not len(y):
        return np.zeros(1), np.full(1, 0.5)
    xs, at = np.unique(score, return_inverse=True)
    w = np.bincount(at).astype(float)
    v = np.bincount(at, y) / w
    pools: list[list[float]] = []     # value, weight, points
    for value, weight in zip(v, w, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    fitted = np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])
    return xs, fitted
