"""Gradient-boosted trees for binary labels in numpy: small, fitted on the driver from bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: feature, threshold of each inner node and value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, bins: int = 32) -> Trees:
    """Newton boosting of the log-loss over quantile cuts; ties take the first feature and cut."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    z = np.full(len(y), base)
    inner = (1 << depth) - 1
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f_, t_ = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf)
            for j, c in enumerate(cuts):
                if not len(c) or not len(rows):
                    continue
                gl = np.cumsum(np.bincount(code[rows, j], g[rows], len(c) + 1))
                hl = np.cumsum(np.bincount(code[rows, j], h[rows], len(c) + 1))
                gain = gl**2 / (hl + l2) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + l2) - gl[-1] ** 2 / (hl[-1] + l2)
                i = int(gain[:-1].argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, float(c[i]))
            f_[k], t_[k] = best[1], best[2]
            node[rows] = 2 * k + 1 + (x[rows, f_[k]] > t_[k])
        leaf = np.array([-rate * g[node == inner + i].sum() / (h[node == inner + i].sum() + l2) for i in range(inner + 1)])
        z += leaf[node - inner]
        features.append(f_)
        thresholds.append(t_)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)
