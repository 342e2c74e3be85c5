"""Structuring elements: arrays (z, y, x) of int; a negative cell is "don't care"."""

from __future__ import annotations

import numpy as np


def box(nz: int, ny: int, nx: int) -> np.ndarray:
    return np.ones((nz, ny, nx), np.int32)


def cube(size: int) -> np.ndarray:
    """All ones, (2 size + 1) cells along each axis."""
    return box(*(2 * size + 1,) * 3)


def square() -> np.ndarray:
    return box(1, 3, 3)


def line_h(length: int) -> np.ndarray:
    """Along x."""
    return box(1, 1, length)


def line_v(length: int) -> np.ndarray:
    """Along y."""
    return box(1, length, 1)


def custom(cells) -> np.ndarray:
    out = np.asarray(cells, np.int32)
    if out.ndim not in (2, 3) or not out.size:
        raise ValueError("a footprint has two or three axes and at least one cell")
    return out[None] if out.ndim == 2 else out


def offsets(footprint: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(dz, dy, dx, value) of the cells that count; the anchor is size // 2."""
    f = custom(footprint)
    return [(int(z) - f.shape[0] // 2, int(y) - f.shape[1] // 2, int(x) - f.shape[2] // 2, int(f[z, y, x])) for z, y, x in zip(*np.nonzero(f >= 0), strict=True)]


def is_full(footprint: np.ndarray) -> bool:
    """No "don't care" cell: a plain box for the grey operators."""
    return bool((custom(footprint) >= 0).all())
