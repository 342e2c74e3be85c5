"""Generated images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from ..volume import Volume


def discs(spark: SparkSession, shape: tuple[int, int, int], count: int = 10, radius: tuple[int, int] = (2, 6), seed: int = 0) -> Volume:
    """Binary slices with filled discs at random places."""
    rng = np.random.default_rng(seed)
    nz, ny, nx = shape
    yy, xx = np.mgrid[:ny, :nx]
    out = np.zeros(shape, np.int32)
    for z in range(nz):
        for _ in range(count):
            r, cy, cx = rng.integers(radius[0], radius[1] + 1), rng.integers(ny), rng.integers(nx)
            out[z][(yy - cy) ** 2 + (xx - cx) ** 2 <= r * r] = 1
    return Volume.from_numpy(spark, out)
