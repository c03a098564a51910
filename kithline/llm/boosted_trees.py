"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """All trees as node arrays. A leaf points to itself, so every row takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds; rows by rows, trees side by side."""
        out = np.full(len(x), self.base)
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[start : start + 4096] += self.value[node].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: float = 2.0) -> FlatTrees:
    """Logistic boosting. monotone: by feature 1 (margin may only rise), -1 (only fall) or 0.

    A split on a constrained feature is taken only if its children's values are in
    order; the children then inherit the middle value as a bound, so that later
    splits below them can't cross it. With one class only, the result is its prior.
    """
    n, m = x.shape
    p = np.clip(y.mean() if n else 0.5, 0.001, 0.999)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1) if n else np.zeros((0, m), np.int64)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        feature.append(0), threshold.append(np.inf), left.append(len(left)), right.append(len(right)), value.append(v)
        return len(value) - 1

    margin = np.full(n, base)
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = y - prob, prob * (1 - prob)
        root = node(0.0)
        roots.append(root)
        open_ = [(root, np.arange(n), -np.inf, np.inf, 0)]
        while open_:
            at, rows, low, high, level = open_.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            own = float(np.clip(g / (h + l2), low, high))
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level < depth and h > 2 * least:
                for j in range(m):
                    size = len(edges[j]) + 1
                    if size < 2:
                        continue
                    gs = np.cumsum(np.bincount(code[rows, j], grad[rows], size))[:-1]
                    hs = np.cumsum(np.bincount(code[rows, j], hess[rows], size))[:-1]
                    vl, vr = np.clip(gs / (hs + l2), low, high), np.clip((g - gs) / (h - hs + l2), low, high)
                    # gain of the clipped values, so that constrained and free splits compare
                    gain = sum(v * a - 0.5 * (b + l2) * v * v for v, a, b in ((vl, gs, hs), (vr, g - gs, h - hs))) - (own * g - 0.5 * (h + l2) * own * own)
                    ok = (hs >= least) & (h - hs >= least) & ((vr - vl) * monotone[j] >= 0)
                    gain = np.where(ok, gain, -1.0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            _, j, k, vl, vr = best
            if j < 0:
                value[at] = rate * own
                margin[rows] += rate * own
                continue
            feature[at], threshold[at] = j, edges[j][k]
            goes = code[rows, j] <= k
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[j]]
            for side, own_rows, (a, b) in ((left, rows[goes], bounds[0]), (right, rows[~goes], bounds[1])):
                side[at] = node(0.0)
                open_.append((side[at], own_rows, a, b, level + 1))
    as_int = lambda v: np.array(v or [0], np.int64)
    return FlatTrees(as_int(feature), np.array(threshold or [np.inf]), as_int(left), as_int(right), np.array(value or [0.0]), np.array(roots, np.int64), depth, base)
