"""Gradient-boosted trees and isotonic calibration in numpy, for models fitted on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees of one depth; node ``i`` has the children ``2i+1`` and ``2i+2``."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (leaf.size - 1)]
        return out


def _best_split(codes: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, ridge: float) -> tuple[int, int]:
    """Feature and bin of the split with the largest gain; (-1, 0) if none gains."""
    best, where = 1e-9, (-1, 0)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for j in range(codes.shape[1]):
        gl = np.cumsum(np.bincount(codes[:, j], g, bins))[:-1]
        hl = np.cumsum(np.bincount(codes[:, j], h, bins))[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl > 1e-3) & (hr > 1e-3), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole, 0.0)
        k = int(gain.argmax())
        if gain[k] > best:
            best, where = gain[k], (j, k)
    return where


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Forest:
    """Boosting with the logistic loss over quantile bins of the features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate_of_ones = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for i in range(inner):
            at = np.flatnonzero(node == i)
            j, k = _best_split(codes[at], g[at], h[at], bins, ridge) if len(at) > 1 else (-1, 0)
            if j >= 0:
                feature[t, i], threshold[t, i] = j, edges[j][k]
                node[at] = 2 * i + 1 + (codes[at, j] > k)
            else:
                node[at] = 2 * i + 1
        for i in range(leaves):
            at = node == i + inner
            leaf[t, i] = rate * g[at].sum() / (h[at].sum() + ridge)
        margin += leaf[t][node - inner]
    return Forest(feature, threshold, leaf, base)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their calibrated probabilities, one pseudo-row of each class at the ends.

    ``margin`` has one number or more.
    """
    # Rows of one margin are one block from the start, so that their order doesn't matter.
    m, at = np.unique(np.r_[margin.min() - 1, margin, margin.max() + 1], return_inverse=True)
    count = np.bincount(at).astype(float)
    ones = np.bincount(at, np.r_[0.0, y, 1.0])
    blocks: list[list[float]] = []  # sum, count, sum of margins
    for a, n, b in zip(m, count, ones):
        blocks.append([b, n, a * n])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def calibrated(margin: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.interp(margin, *knots)
