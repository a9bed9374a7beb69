"""Histogram gradient-boosted trees for a binary label, as flat arrays traversed by numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """All trees in one set of arrays: node k of a tree goes to left[k] if its feature is at most cut[k], else to
    left[k] + 1; a leaf points at itself and has a value."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; every row walks all trees at once, level by level."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            leaf = self.left[at] == at
            step = self.left[at] + (x[rows, self.feature[at]] > self.cut[at])
            at = np.where(leaf, at, step)
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 20, smooth: float = 1.0) -> Boosted:
    """Second-order boosting on quantile bins; every level sums gradients per (node, bin) once per feature.

    One class only, or no rows: no trees, and the score is the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    feature, cut, left, value, roots = [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        raw = np.full(len(y), start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.full(len(y), len(feature))
            roots.append(len(feature))
            level = [len(feature)]
            _grow(feature, cut, left, value)
            for _ in range(depth):
                level = _split_level(level, node, codes, edges, g, h, bins, least, smooth, feature, cut, left, value)
                if not level:
                    break
            leaf_g, leaf_h = np.bincount(node, g, len(feature)), np.bincount(node, h, len(feature))
            for k in range(roots[-1], len(feature)):
                value[k] = float(-rate * leaf_g[k] / (leaf_h[k] + smooth)) if left[k] == k else 0.0
            raw = raw + np.array(value)[node]
    return Boosted(np.array(roots, np.int64), np.array(feature, np.int64), np.array(cut, np.float64), np.array(left, np.int64), np.array(value, np.float64), start, depth)


def _grow(feature, cut, left, value) -> None:
    feature.append(0)
    cut.append(0.0)
    left.append(len(left))
    value.append(0.0)


def _split_level(level, node, codes, edges, g, h, bins, least, smooth, feature, cut, left, value) -> list[int]:
    """Split every node of a level at its best bin; rows move to the children."""
    place = np.full(len(feature), -1)
    place[level] = np.arange(len(level))
    on = np.flatnonzero(place[node] >= 0)
    slot = place[node[on]]
    size = len(level) * bins
    best_gain, best = np.full(len(level), 1e-6), [None] * len(level)
    for f, e in enumerate(edges):
        if not len(e):
            continue
        key = slot * bins + codes[f][on]
        sums = [np.bincount(key, w, size).reshape(len(level), bins).cumsum(axis=1) for w in (g[on], h[on])]
        sums.append(np.bincount(key, minlength=size).reshape(len(level), bins).cumsum(axis=1))
        gl, hl, nl = (s[:, : len(e)] for s in sums)
        gt, ht, nt = (s[:, -1:] for s in sums)
        gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
        gain = np.where((nl >= least) & (nt - nl >= least), gain, -1)
        top = gain.argmax(axis=1)
        for k in np.flatnonzero(gain[np.arange(len(level)), top] > best_gain):
            best_gain[k], best[k] = gain[k, top[k]], (f, int(top[k]))
    new = []
    for k, how in enumerate(best):
        if how is None:
            continue
        parent, (f, b) = level[k], how
        child = len(feature)
        feature[parent], cut[parent], left[parent] = f, float(edges[f][b]), child
        for _ in range(2):
            new.append(len(feature))
            _grow(feature, cut, left, value)
        rows = on[slot == k]
        node[rows] = child + (codes[f][rows] > b)
    return new
