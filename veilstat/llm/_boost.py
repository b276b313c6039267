"""Gradient-boosted trees for log loss on binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees of one depth, as arrays; scores are log odds."""

    base: float
    depth: int
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Boosted:
    """Second-order boosting; each split maximises the gain over at most `bins` quantile cuts a feature."""
    p = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    model = Boosted(np.log(p / (1 - p)), depth)
    if len(y) == 0 or y.min() == y.max():
        return model
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(n_features)]
    # Rare features: quantiles alone would see only zeros, so the distinct positive values get cuts too.
    edges = [np.unique(np.concatenate([e, np.quantile(v, np.linspace(0, 1, 9)[:-1]) - 1e-9])) if len(v := x[x[:, j] > 0, j]) else e for j, e in enumerate(edges)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    width = max(len(e) for e in edges) + 1
    margin = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = q - y, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.full(count, 1e-6)
            for j in range(n_features):
                key = at * width + code[:, j]
                g = np.bincount(key, grad, count * width).reshape(count, width).cumsum(1)
                h = np.bincount(key, hess, count * width).reshape(count, width).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[(h < least) | (ht - h < least)] = -1
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better] = top[better]
                feature[first + np.flatnonzero(better)] = j
                cut[first + np.flatnonzero(better)] = edges[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + ridge)
        margin += leaf[at]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(leaf)
    return model


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: (scores, probabilities) to interpolate between.

    Equal scores are one point. A block's share is smoothed by one pseudo-row of the overall share, so none is 0 or 1.
    """
    xs, inverse = np.unique(scores, return_inverse=True)
    hits, rows = np.bincount(inverse, y.astype(float), len(xs)), np.bincount(inverse, minlength=len(xs)).astype(float)
    blocks: list[list[float]] = []  # hits, rows, first score, last score
    for point in zip(hits.tolist(), rows.tolist(), xs.tolist(), xs.tolist(), strict=True):
        blocks.append(list(point))
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h, blocks[-1][1] + n, blocks[-1][2], last]
    share = float(y.mean()) if len(y) else 0.0
    ends = np.array([x for b in blocks for x in (b[2], b[3])])
    values = np.array([(b[0] + share) / (b[1] + 1) for b in blocks for _ in range(2)])
    return ends, np.maximum.accumulate(values) if len(values) else values
