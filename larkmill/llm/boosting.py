"""Gradient-boosted trees for two classes, by histograms, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees of ``depth`` splits, stored by level; leaves hold log-odds."""

    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k in range(len(self.leaf)):
            out += self.tree(k, x)
        return out

    def tree(self, k: int, x: np.ndarray) -> np.ndarray:
        rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[k][at]] > self.limit[k][at])
        return self.leaf[k][at - (2**self.depth - 1)]


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0,
    share: float = 0.4, seed: int = 1,
) -> Boosted:
    """Fits log-odds of ``y`` (0 or 1) by second-order boosting; splits are searched over quantile bins, each tree on a
    random ``share`` of the rows."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], axis=1)
    mean = np.clip(y.mean(), 0.01, 0.99)
    model = Boosted(depth, float(np.log(mean / (1 - mean))))
    score = np.full(n, model.base)
    inner = 2**depth - 1
    draw = np.random.default_rng(seed)
    for _ in range(trees):
        some = np.flatnonzero(draw.random(n) < share)
        p = 1 / (1 + np.exp(-score[some]))
        grad, hess = y[some] - p, np.maximum(p * (1 - p), 1e-6)
        own_bins, own_x = np.ascontiguousarray(binned[some].T), x[some]
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(some), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.zeros(wide)
            cut_at = np.full(wide, bins)
            for j in range(d):
                key = (at - first) * bins + own_bins[j]
                g = np.bincount(key, grad, wide * bins).reshape(wide, bins).cumsum(1)
                h = np.bincount(key, hess, wide * bins).reshape(wide, bins).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                own = gain[np.arange(wide), top]
                better = own > best + 1e-9
                best[better], cut_at[better], feature[first : first + wide][better] = own[better], top[better], j
                limit[first : first + wide][better] = [cuts[j][t] for t in top[better]]
            split = feature[at]
            at = 2 * at + 1 + (own_x[np.arange(len(some)), split] > limit[at])
        leaves = at - inner
        value = rate * np.bincount(leaves, grad, inner + 1) / (np.bincount(leaves, hess, inner + 1) + ridge)
        model.feature.append(feature)
        model.limit.append(limit)
        model.leaf.append(value)
        score += model.tree(len(model.leaf) - 1, x)
    return model
