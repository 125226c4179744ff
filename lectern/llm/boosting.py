"""Gradient-boosted trees of depth two for small tables of features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting; features are cut at quantiles, each tree splits once and each side once more."""

    def __init__(self, rounds: int = 60, rate: float = 0.3, bins: int = 24, decay: float = 1.0):
        self.rounds, self.rate, self.bins, self.decay = rounds, rate, bins, decay
        self.trees: list[tuple] = []
        self.base = 0.0

    def _split(self, codes, gradient, hessian, rows):
        """(gain, feature, bin) of the best cut of `rows`: codes <= bin go left."""
        best = (0.0, 0, -1)
        total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
        for f in range(codes.shape[1]):
            g = np.cumsum(np.bincount(codes[rows, f], gradient[rows], self.bins + 1))[:-1]
            h = np.cumsum(np.bincount(codes[rows, f], hessian[rows], self.bins + 1))[:-1]
            gain = g**2 / (h + self.decay) + (total_g - g) ** 2 / (total_h - h + self.decay) - total_g**2 / (total_h + self.decay)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, k)
        return best

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> Boosted:
        w = np.ones(len(y)) if weights is None else weights
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1)
        mean = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, hessian = w * (y - p), w * p * (1 - p)
            everything = np.arange(len(y))
            _, f, k = self._split(codes, gradient, hessian, everything)
            if k < 0:
                break
            left = codes[:, f] <= k
            sides = []
            for side in (left, ~left):
                rows = everything[side]
                _, f2, k2 = self._split(codes, gradient, hessian, rows)
                leaves = []
                for part in ((rows[codes[rows, f2] <= k2], rows[codes[rows, f2] > k2]) if k2 >= 0 else (rows, rows[:0])):
                    value = self.rate * gradient[part].sum() / (hessian[part].sum() + self.decay)
                    score[part] += value
                    leaves.append(float(value))
                sides.append((f2, k2, leaves) if k2 >= 0 else (0, len(self.edges[0]) + 1, leaves))
            self.trees.append((f, k, sides))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows."""
        codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, 1), int)
        out = np.full(len(x), self.base)
        for f, k, sides in self.trees:
            left = codes[:, f] <= k
            for side, (f2, k2, leaves) in zip((left, ~left), sides, strict=True):
                out[side] += np.where(codes[side, f2] <= k2, leaves[0], leaves[1])
        return out
