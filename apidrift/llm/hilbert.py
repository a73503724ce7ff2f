"""Documents as hashed vectors, and their places along a Hilbert curve."""

from __future__ import annotations

import numpy as np

BUCKETS, DIMENSIONS, BITS, SEED = 256, 4, 12, 20240607
#: Multiplier of Fibonacci hashing, 2^32 divided by the golden ratio (fixed value).
MULTIPLIER = 2654435761


def projection() -> np.ndarray:
    directions = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))
    return directions / np.linalg.norm(directions, axis=0)


def projected(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each text's ids hashed to ``BUCKETS`` damped counts of unit length, then projected: values in [-1, 1]."""
    bucket = (ids.astype(np.uint64) * np.uint64(MULTIPLIER) >> np.uint64(16) & np.uint64(BUCKETS - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    hashed = np.log1p(np.bincount(owner * BUCKETS + bucket, minlength=len(counts) * BUCKETS).reshape(-1, BUCKETS))
    return hashed @ projection() / np.maximum(np.linalg.norm(hashed, axis=1, keepdims=True), 1e-12)


def curve_key(points: np.ndarray) -> np.ndarray:
    """Hilbert index of points in [-1, 1]; the curve is folded from the coarsest bit plane down to the finest."""
    axes = list(np.clip((points + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.int64).T)
    for plane in reversed(range(1, BITS)):
        below = (1 << plane) - 1
        for i, axis in enumerate(axes):
            upper = (axis >> plane & 1).astype(bool)
            swap = np.where(upper, 0, (axes[0] ^ axis) & below)
            # In an upper half the first axis is reflected, otherwise it trades its lower bits with this one.
            axes[0] = np.where(upper, axes[0] ^ below, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for plane in range(1, BITS):
        turn = np.where(axes[-1] >> plane & 1, turn ^ (1 << plane) - 1, turn)
    key = np.zeros_like(axes[0])
    for plane in reversed(range(BITS)):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> plane & 1)
    return key
