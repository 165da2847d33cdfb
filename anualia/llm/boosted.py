"""Gradient-boosted regression trees for a yes/no label, on binned features.

Trees have a fixed depth and are stored as arrays, so that a whole batch of rows
walks down all of them with a few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES = 60
DEPTH = 4
BINS = 32
RATE = 0.2
RIDGE = 1.0


@dataclass(frozen=True)
class Forest:
    """Per tree: feature and threshold of the inner nodes (heap order), values of the leaves."""

    base: float
    features: np.ndarray
    limits: np.ndarray
    leaves: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of the label for each row."""
        out = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        inner = self.features.shape[1] if self.features.size else 0
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(rows), np.intp)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[at, feature[node]] > limit[node])
            out += leaf[node - inner]
        return out


def _cuts(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 distinct cut points."""
    return np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))


def train(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """Second-order boosting of the logistic loss."""
    n, width = rows.shape
    share = min(max(float(labels.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if n == 0 or labels.min() == labels.max():
        return Forest(base, np.zeros((0, 0), np.intp), np.zeros((0, 0)), np.zeros((0, 0)))
    cuts = [_cuts(rows[:, f]) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(width)])
    inner = (1 << DEPTH) - 1
    score = np.full(n, base)
    all_features, all_limits, all_leaves = [], [], []
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-score))
        slope, curve = labels - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.intp), np.full(inner, np.inf)
        node = np.zeros(n, np.intp)
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            local = node - first
            best = np.zeros(count)
            g = np.bincount(local, slope, count)
            h = np.bincount(local, curve, count)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                cell = local * BINS + binned[f]
                left_g = np.bincount(cell, slope, count * BINS).reshape(count, BINS).cumsum(1)[:, : len(cuts[f])]
                left_h = np.bincount(cell, curve, count * BINS).reshape(count, BINS).cumsum(1)[:, : len(cuts[f])]
                right_g, right_h = g[:, None] - left_g, h[:, None] - left_h
                gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - (g**2 / (h + RIDGE))[:, None]
                cut = gain.argmax(1)
                won = gain[np.arange(count), cut]
                better = won > best + 1e-9
                best[better] = won[better]
                feature[first : first + count][better] = f
                limit[first : first + count][better] = cuts[f][cut[better]]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > limit[node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        value = RATE * g / (h + RIDGE)
        score += value[leaf]
        all_features.append(feature)
        all_limits.append(limit)
        all_leaves.append(value)
    return Forest(base, np.array(all_features), np.array(all_limits), np.array(all_leaves))
