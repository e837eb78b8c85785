"""Gradient-boosted regression trees for two classes in numpy (histograms, logistic loss, fixed depth)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of one depth as flat arrays; node k has children 2k + 1 and 2k + 2."""

    def __init__(self, features, cuts, values, base: float):
        self.features, self.cuts, self.values, self.base = features, cuts, values, base

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x`` (float32)."""
        out = np.full(len(x), self.base)
        inner = self.features.shape[1]
        flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
        row = np.arange(len(x)) * width
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (flat[row + feature[node]] > cut[node])
            out += value[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 5.0, bins: int = 32) -> BoostedTrees:
    """Trees for labels ``y`` (0 or 1) of the rows of ``x``; ties between splits go to the lowest feature and cut."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    coded = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    logit = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves))
    slot = np.arange(d) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-12
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (d * bins) + slot + coded).ravel()
            sums = [np.bincount(at, np.repeat(v, d), width * d * bins).reshape(width, d, bins).cumsum(axis=2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            for k in range(width):
                j, b = np.unravel_index(int(np.argmax(np.round(gain[k], 9))), (d, bins))
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    features[t, first + k], cuts[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > cuts[t, node])
        leaf = node - inner
        values[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        logit += values[t][leaf]
    return BoostedTrees(features, cuts, values, base)
