"""Gradient-boosted trees on a bounded table of features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS = 40
DEPTH = 3
RATE = 0.2
BINS = 16
LEAST_WEIGHT = 1.0


@dataclass
class Trees:
    """Complete trees of equal depth: per tree the features and thresholds of its inner nodes, and its leaves."""

    features: np.ndarray  # [tree, node]
    thresholds: np.ndarray  # [tree, node]
    leaves: np.ndarray  # [tree, leaf]
    start: float

    def chance(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-margin))


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Fit by second-order logistic boosting over quantile bins; deterministic. One class gives no trees."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    inner, n_leaves = 2**DEPTH - 1, 2**DEPTH
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, n_leaves)), start)
    if len(np.unique(y)) < 2:
        return empty
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    margin = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                size = len(c) + 1
                key = (node - first) * size + binned[:, f]
                g = np.bincount(key, gradient, width * size).reshape(width, size)
                h = np.bincount(key, weight, width * size).reshape(width, size)
                left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
                all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - all_g**2 / (all_h + 1)
                gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[first + better] = f
                threshold[first + better] = c[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, n_leaves), np.bincount(leaf, weight, n_leaves)
        values = -RATE * g / (h + 1)
        margin += values[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(values)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)
