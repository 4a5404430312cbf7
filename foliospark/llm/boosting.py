"""Gradient-boosted trees for two classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Complete binary trees as arrays: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes)
    value: np.ndarray  # (trees, leaves)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1]))
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, penalty: float = 2.0, least: float = 5.0) -> Boosted:
    """Fit by second-order boosting of the logistic loss over binned features.

    Deterministic: no sampling. Thresholds are quantiles of each feature; a node splits on
    the largest gain, or sends all rows left where no split gains.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    values = np.zeros((trees, leaves))
    flat = codes + np.arange(m) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            here = at - first
            cell = (here[:, None] * (m * bins) + flat).ravel()
            size = count * m * bins
            sums = [np.bincount(cell, np.repeat(w, m), size).reshape(count, m, bins).cumsum(axis=2) for w in (g, h)]
            left_g, left_h = sums
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
            gain[(left_h < least / 4) | (right_h < least / 4)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    features[t, first + k], thresholds[t, first + k] = j, edges[j][b]
            f, cut = features[t, at], thresholds[t, at]
            at = 2 * at + 1 + (x[np.arange(n), f] > cut)
        leaf = at - inner
        values[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + penalty)
        score += values[t][leaf]
    return Boosted(base, features, thresholds, values)
