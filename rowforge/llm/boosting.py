"""Gradient-boosted regression trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of fixed depth kept as arrays; predict() gives log odds."""

    def __init__(self, rounds: int = 60, depth: int = 6, rate: float = 0.15, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.smooth = rounds, depth, rate, smooth
        self.base, self.features, self.cuts, self.leaves = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
        share = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(x), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, curve = weight * (y - p), weight * p * (1 - p)
            at = np.zeros(len(x), dtype=np.int64)
            nodes = 2**self.depth - 1
            feature, cut = np.zeros(nodes, dtype=np.int64), np.full(nodes, np.inf)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best, where = np.full(many, 1e-9), [(0, np.inf)] * many
                local = at - first
                total_g = np.bincount(local, gradient, many)
                total_c = np.bincount(local, curve, many)
                whole = total_g**2 / (total_c + self.smooth)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = local * (len(e) + 1) + binned[:, f]
                    g = np.bincount(key, gradient, many * (len(e) + 1)).reshape(many, -1).cumsum(axis=1)[:, :-1]
                    c = np.bincount(key, curve, many * (len(e) + 1)).reshape(many, -1).cumsum(axis=1)[:, :-1]
                    gain = g**2 / (c + self.smooth) + (total_g[:, None] - g) ** 2 / (total_c[:, None] - c + self.smooth) - whole[:, None]
                    k = gain.argmax(axis=1)
                    for n in np.flatnonzero(gain[np.arange(many), k] > best):
                        best[n], where[n] = gain[n, k[n]], (f, e[k[n]])
                for n, (f, value) in enumerate(where):
                    feature[first + n], cut[first + n] = f, value
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] >= cut[at])
            local = at - nodes
            leaf = np.bincount(local, gradient, nodes + 1) / (np.bincount(local, curve, nodes + 1) + self.smooth) * self.rate
            score += leaf[local]
            self.features.append(feature)
            self.cuts.append(cut)
            self.leaves.append(leaf)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] >= cut[at])
            score += leaf[at - len(feature)]
        return score
