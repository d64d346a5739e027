"""Gradient-boosted trees over small dense matrices, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Bins:
    """A matrix by the bins of its columns, and a number per row that is equal for equal bins."""

    def __init__(self, x: np.ndarray, bins: int = 16) -> None:
        self.cuts = []
        for c in x.T:
            values = np.unique(c)
            self.cuts.append((values[1:] + values[:-1]) / 2 if len(values) <= bins else np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])))
        self.binned = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T)], 1).astype(np.uint8)
        factors = np.random.default_rng(1).integers(1, 1 << 62, x.shape[1], np.uint64) | np.uint64(1)
        self.codes = (self.binned.astype(np.uint64) * factors).sum(1)


class Trees:
    """Logistic boosting with histogram splits. All nodes of a level share their split, so a row's leaf is the number whose bits
    are its answers, and a forest is applied by comparisons and look-ups alone. Margins start from 0."""

    def __init__(self, rounds: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 16, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[list[int], list[float], np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, bins: Bins | None = None, rows: np.ndarray | None = None) -> Trees:
        """y: targets between 0 and 1. Rows that fall into the same bins are one row to the fit. bins and rows: those of x where it was binned before."""
        self.trees = []
        bins = bins or Bins(x, self.bins)
        rows = np.arange(len(x)) if rows is None else rows
        if not len(rows):
            return self
        _, one, first = np.unique(bins.codes[rows], return_index=True, return_inverse=True)
        binned, cuts, first = bins.binned[rows[one]], bins.cuts, first.reshape(-1)
        total = np.bincount(first, weight, len(binned))
        good = np.bincount(first, weight * y, len(binned))
        n, f = binned.shape
        wide = self.bins + 1
        flat = binned + np.arange(f, dtype=np.int64) * wide
        margin = np.zeros(n)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = good - total * p, np.maximum(p * (1 - p), 1e-4) * total
            leaf = np.zeros(n, np.int64)
            features, values = [], []
            for level in range(self.depth):
                cells = ((leaf * (f * wide))[:, None] + flat).ravel()
                g = np.bincount(cells, np.repeat(grad, f), (1 << level) * f * wide).reshape(-1, f, wide)
                h = np.bincount(cells, np.repeat(hess, f), (1 << level) * f * wide).reshape(-1, f, wide)
                low_g, low_h = g.cumsum(2), h.cumsum(2)
                all_g, all_h = low_g[:, :, -1:], low_h[:, :, -1:]
                gain = (low_g**2 / (low_h + self.ridge) + (all_g - low_g) ** 2 / (all_h - low_h + self.ridge) - all_g**2 / (all_h + self.ridge)).sum(0)
                for k, c in enumerate(cuts):
                    gain[k, len(c) :] = -1
                k, b = divmod(int(gain.argmax()), wide)
                if gain[k, b] <= 1e-6:
                    break
                features.append(k)
                values.append(float(cuts[k][b]))
                leaf = leaf * 2 + (binned[:, k] > b)
            sums = np.bincount(leaf, grad, 1 << len(features)), np.bincount(leaf, hess, 1 << len(features))
            value = self.rate * sums[0] / (sums[1] + self.ridge)
            margin += value[leaf]
            self.trees.append((features, values, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        columns = np.ascontiguousarray(x.T)
        asked: dict[tuple[int, float], np.ndarray] = {}
        for features, values, value in self.trees:
            leaf = np.zeros(len(x), np.int8)
            for f, v in zip(features, values):
                if (f, v) not in asked:
                    asked[f, v] = (columns[f] >= v).astype(np.int8)
                leaf = leaf * 2 + asked[f, v]
            out += value[leaf]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the best non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, w in zip(score[order], y[order], weight[order]):
        blocks.append([v * w, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2], top[3]]
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.array(xs), np.array(ys)
