"""Linear classifiers over sparse hashed features, fitted in numpy on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of (column, value) entries: ``owner`` ascending."""

    owner: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n_rows: int

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Rows times a (columns, classes) matrix."""
        return np.stack([np.bincount(self.owner, self.value * w[self.column], self.n_rows) for w in weights.T], axis=1)

    def transposed_times(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.stack([np.bincount(self.column, self.value * v[self.owner], width) for v in values.T], axis=1)

    def rows(self, keep: np.ndarray) -> Sparse:
        """The rows where ``keep`` holds."""
        number = np.cumsum(keep) - 1
        at = keep[self.owner]
        return Sparse(number[self.owner[at]], self.column[at], self.value[at], int(keep.sum()))


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def sigmoid(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def fit_linear(rows: Sparse, targets: np.ndarray, width: int, link, l2: float = 1e-5, rounds: int = 150, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (columns, classes) and intercepts by full-batch AdaGrad; ``targets`` has a column per class.

    ``link`` is :func:`softmax` or :func:`sigmoid`, whose losses share their gradient. Deterministic.
    """
    n = max(len(targets), 1)
    weights, bias = np.zeros((width, targets.shape[1])), np.zeros(targets.shape[1])
    seen, seen_bias = np.full(weights.shape, 1e-12), np.full(bias.shape, 1e-12)
    for _ in range(rounds):
        miss = (link(rows.times(weights) + bias) - targets) / n
        gradient, gradient_bias = rows.transposed_times(miss, width) + l2 * weights, miss.sum(axis=0)
        seen += gradient**2
        seen_bias += gradient_bias**2
        weights -= rate * gradient / np.sqrt(seen)
        bias -= rate * gradient_bias / np.sqrt(seen_bias)
    return weights, bias
