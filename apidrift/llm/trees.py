"""Small decision trees and boosted ensembles in numpy, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees in a row. ``feature`` is -1 at a leaf, whose children are itself; ``roots`` start the trees."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float = 0.0

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Base plus the leaf values, for all rows and trees at once; a value up to the threshold goes left."""
        node = np.repeat(self.roots[None, :], len(rows), axis=0)
        at = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            goes_left = rows[at, np.maximum(self.feature[node], 0)] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(rows)))


class _Grower:
    """Grows one tree by second-order gain; ``monotone`` per feature: -1 falling, 0 free, 1 rising."""

    def __init__(self, rows, monotone, depth, min_rows, l2, bins):
        self.monotone, self.depth, self.min_rows, self.l2 = monotone, depth, min_rows, l2
        self.cuts = []
        for column in rows.T:
            values = np.unique(column)
            if len(values) > bins:
                values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
            self.cuts.append((values[:-1] + values[1:]) / 2)
        self.binned = np.stack([np.searchsorted(c, column) for c, column in zip(self.cuts, rows.T)], axis=1)
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def grow(self, gradient, hessian, rate):
        root = len(self.feature)
        self._node(np.arange(len(gradient)), gradient, hessian, rate, self.depth, -np.inf, np.inf)
        return root

    def _weight(self, g, h):
        return -g / np.maximum(h + self.l2, 1e-12)

    def _node(self, rows, gradient, hessian, rate, depth, low, high):
        at = len(self.feature)
        g, h = gradient[rows].sum(), hessian[rows].sum()
        for store, value in ((self.feature, -1), (self.threshold, 0.0), (self.left, at), (self.right, at)):
            store.append(value)
        self.value.append(rate * float(np.clip(self._weight(g, h), low, high)))
        split = self._split(rows, gradient, hessian, low, high) if depth else None
        if split:
            _, feature, cut, weights = split
            middle = sum(weights) / 2
            goes_left = self.binned[rows, feature] <= cut
            bounds = {0: ((low, high),) * 2, 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            left, right = bounds[int(self.monotone[feature])]
            self.feature[at], self.threshold[at], self.value[at] = feature, self.cuts[feature][cut], 0.0
            self.left[at] = self._node(rows[goes_left], gradient, hessian, rate, depth - 1, *left)
            self.right[at] = self._node(rows[~goes_left], gradient, hessian, rate, depth - 1, *right)
        return at

    def _split(self, rows, gradient, hessian, low, high):
        best = None
        for feature, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            bins, size = self.binned[rows, feature], len(cuts) + 1
            g, h, n = (np.cumsum(np.bincount(bins, w, size))[:-1] for w in (gradient[rows], hessian[rows], np.ones(len(rows))))
            total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
            left = np.clip(self._weight(g, h), low, high)
            right = np.clip(self._weight(total_g - g, total_h - h), low, high)
            parent = np.clip(self._weight(total_g, total_h), low, high)
            # Fall of the quadratic loss at clipped weights, so that the constraints are priced in.
            loss = lambda w, g, h: g * w + (h + self.l2) * w * w / 2
            gain = loss(parent, total_g, total_h) - loss(left, g, h) - loss(right, total_g - g, total_h - h)
            wrong = (n < self.min_rows) | (len(rows) - n < self.min_rows) | (self.monotone[feature] * (right - left) < 0)
            gain = np.where(wrong, -np.inf, gain)
            cut = int(np.argmax(gain))
            if gain[cut] > 1e-9 and (best is None or gain[cut] > best[0]):
                best = (gain[cut], feature, cut, (left[cut], right[cut]))
        return best

    def trees(self, roots, base=0.0):
        return Trees(
            np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right),
            np.array(self.value), np.array(roots), self.depth, base,
        )


def decision_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 4, min_rows: int = 1) -> Trees:
    """One least-squares tree; its margin is the share of ones in the leaf."""
    rows, labels = np.asarray(rows, float), np.asarray(labels, float)
    grower = _Grower(rows, np.zeros(rows.shape[1], int), depth, min_rows, 0.0, 256)
    return grower.trees([grower.grow(-labels, np.ones(len(labels)), 1.0)])


def boosted_trees(
    rows: np.ndarray, labels: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, min_rows: int = 8, l2: float = 1.0
) -> Trees:
    """Logistic gradient boosting under monotonic constraints. One class only (or no rows): a constant."""
    rows, labels = np.asarray(rows, float), np.asarray(labels, float)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(labels)) < 2:
        return Trees(*(np.array([x]) for x in (-1, 0.0, 0, 0, 0.0, 0)), 0, base)
    grower = _Grower(rows, monotone, depth, min_rows, l2, 128)
    roots, margin = [], np.full(len(rows), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(grower.feature)
        roots.append(grower.grow(p - labels, p * (1 - p), rate))
        grown = grower.trees([first])
        margin = margin + grown.margin(rows)
    return grower.trees(roots, base)
