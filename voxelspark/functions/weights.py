"""One-dimensional weights {offset: weight} of the separable filters."""

from __future__ import annotations

import math

SMOOTH = {-1: 1.0, 0: 2.0, 1: 1.0}
FLAT = {-1: 1.0, 0: 1.0, 1: 1.0}
#: Correlation with [1, 0, -1].
DIFF = {-1: 1.0, 1: -1.0}


def gaussian(sigma: float, size: int) -> dict[int, float]:
    """exp(-d^2 / (2 sigma^2)), normalised; an even size reaches one cell further down."""
    raw = {i - size // 2: math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma + 1e-16)) for i in range(size)}
    total = sum(raw.values())
    return {o: w / total for o, w in raw.items()}


def filter_size(sigma: float) -> int:
    return math.ceil(4 * sigma + 0.5)


def threshold_size(sigma: float) -> int:
    return math.ceil(6 * sigma + 1)


def flat(size: int) -> dict[int, float]:
    return {i - size // 2: 1.0 for i in range(size)}
