"""Small gradient-boosted trees for a yes/no label, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Trees:
    """Trees of one depth as arrays: a feature and a cut for each inner node."""

    depth: int
    start: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            total += leaf[at - (2**self.depth - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return _sigmoid(a * self.margin(x) + b)


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    n_trees: int = 40,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    smooth: float = 1.0,
) -> Trees:
    """Boosted trees on logistic loss, cuts between quantiles of the features."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(depth, float(np.log(share / (1 - share))))
    levels = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(v, c, side="left") for v, c in zip(levels, x.T)], axis=1)
    margin = np.full(len(y), model.start)
    for _ in range(n_trees):
        p = _sigmoid(margin)
        grad, hess = y - p, p * (1 - p)
        feature = np.zeros(2**depth - 1, dtype=np.int64)
        cut = np.full(2**depth - 1, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(2**depth - 1):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            g, h = grad[rows], hess[rows]
            base = g.sum() ** 2 / (h.sum() + smooth)
            for j, values in enumerate(levels):
                if not len(rows) or not len(values):
                    continue
                left_g = np.bincount(binned[rows, j], g, len(values) + 1)[:-1].cumsum()
                left_h = np.bincount(binned[rows, j], h, len(values) + 1)[:-1].cumsum()
                gain = (
                    left_g**2 / (left_h + smooth)
                    + (g.sum() - left_g) ** 2 / (h.sum() - left_h + smooth)
                    - base
                )
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], j, values[k]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        leaf = at - (2**depth - 1)
        leaves = rate * np.bincount(leaf, grad, 2**depth)
        leaves /= np.bincount(leaf, hess, 2**depth) + smooth
        margin += leaves[leaf]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(leaves)
    return model


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's ``a`` and ``b``: sigmoid(a * margin + b) fits the labels of rows
    the model did not learn from. Newton steps on smoothed labels."""
    up = (y.sum() + 1) / (y.sum() + 2)
    down = 1 / ((1 - y).sum() + 2)
    goal, theta = np.where(y > 0, up, down), np.array([1.0, 0.0])
    z = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(steps):
        p = _sigmoid(z @ theta)
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, z.T @ (goal - p))
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])
