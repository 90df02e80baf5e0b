"""Histogram gradient-boosted trees in numpy, and isotonic calibration.

Trees are complete binary trees of one depth, stored as flat arrays: for tree t, feature
and threshold of inner node i lie at [t, i], its children are 2i+1 and 2i+2, and the
leaves' values at [t, leaf]. A batch of rows walks a tree in ``depth`` vectorised steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    base: float
    feature: np.ndarray  # (trees, 2**depth - 1) int
    threshold: np.ndarray  # same shape; rows go right if x > threshold
    value: np.ndarray  # (trees, 2**depth)
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(np.asarray(x, dtype=np.float64)), -40, 40)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    l2: float = 1.0,
    min_rows: int = 5,
) -> Forest:
    """Logistic loss. With no rows the score is 0.5 everywhere, with one class near it."""
    inner, leaves = 2**depth - 1, 2**depth
    n = len(y)
    if n == 0:
        return Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), depth)
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    p = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(p / (1 - p)))
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    # A value equal to a cut stays left of it, as x > threshold decides in raw().
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    feature, threshold, value = [], [], []
    score = np.full(n, base)
    for _ in range(trees):
        prob = 1.0 / (1.0 + np.exp(-score))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(count)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                at = local * bins + code[:, j]
                gs = np.bincount(at, g, count * bins).reshape(count, bins).cumsum(1)
                hs = np.bincount(at, h, count * bins).reshape(count, bins).cumsum(1)
                cs = np.bincount(at, minlength=count * bins).reshape(count, bins).cumsum(1)
                gl, hl, cl = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain = np.where((cl >= min_rows) & (ct - cl >= min_rows), gain, 0.0)[:, : len(cuts[j])]
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                better = top > best + 1e-12
                best = np.where(better, top, best)
                f[first : first + count][better] = j
                t[first : first + count][better] = cuts[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        score += v[leaf]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return Forest(base, np.array(feature), np.array(threshold), np.array(value), depth)


@dataclass
class Isotonic:
    x: np.ndarray
    y: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return score if not len(self.x) else np.clip(np.interp(score, self.x, self.y), 0.0, 1.0)


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; between the blocks' mean scores it interpolates."""
    if len(score) == 0 or len(np.unique(y)) < 2:
        return Isotonic(np.zeros(0), np.zeros(0))
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # label sum, rows, score sum
    for s, label in zip(score[order], y[order], strict=True):
        blocks.append([float(label), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], a, strict=True)]
    b = np.array(blocks)
    x, v = b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]
    # Scores beyond the outermost blocks run on to 0 and 1.
    return Isotonic(np.concatenate([[0.0], x, [1.0]]), np.concatenate([[min(v[0], x[0])], v, [max(v[-1], x[-1])]]))
