"""Gradient-boosted trees in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of complete trees of a fixed depth over binned features. odds: what the features have learned of tokens, kept with the trees."""

    odds: np.ndarray

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 24) -> None:
        self.depth = depth
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, x.T, strict=True)], axis=1)
        n, d = binned.shape
        p = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        self.feature, self.cut, self.leaf = [], [], []
        columns = np.arange(d) * bins
        for _ in range(trees):
            q = 1 / (1 + np.exp(-score))
            g, h = weight * (q - y), weight * q * (1 - q)
            node, f_all, c_all = np.zeros(n, np.int64), [], []
            for level in range(depth):
                flat = (node[:, None] * (d * bins) + columns + binned).ravel()
                size = (1 << level) * d * bins
                gs = np.bincount(flat, np.repeat(g, d), size).reshape(-1, d, bins)
                hs = np.bincount(flat, np.repeat(h, d), size).reshape(-1, d, bins)
                gl, hl = np.cumsum(gs, axis=2), np.cumsum(hs, axis=2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                best = gain.reshape(len(gain), -1).argmax(axis=1)
                f, c = best // bins, best % bins
                f_all.append(f)
                c_all.append(np.array([self.cuts[i][k] if k < len(self.cuts[i]) else np.inf for i, k in zip(f, c, strict=True)]))
                node = node * 2 + (binned[np.arange(n), f[node]] > c[node])
            leaf = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
            score += leaf[node]
            self.feature.append(f_all)
            self.cut.append(c_all)
            self.leaf.append(leaf)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for features_, cuts, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for f, c in zip(features_, cuts, strict=True):
                node = node * 2 + (x[rows, f[node]] > c[node])
            out += leaf[node]
        return out
