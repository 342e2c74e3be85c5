"""Iteration to a fixpoint, block by block.

A step of a geodesic operator moves information by one voxel. Here each block runs to its own
fixpoint in numpy, with a halo of one voxel, and blocks exchange only through that halo; so the
number of rounds follows the number of blocks a path crosses, not its length. Each round's table
is written to the shared folder, which cuts the lineage, and one aggregate tells whether any
voxel changed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .halo import apply_blocks
from .scratch import remove, written


def fixpoint(df: DataFrame, shape: Sequence[int], step: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str, block: Sequence[int] | None = None) -> DataFrame:
    """Iterate ``v <- step(v, w)`` (w stays) until no voxel changes; step must run each block to
    its own fixpoint. Columns z, y, x, v, w -> z, y, x, v."""
    spark, last = df.sparkSession, None
    df = df.select("z", "y", "x", "v", "w").withColumn("changed", F.lit(True))

    def run(arrays, _):
        new = step(arrays[0], arrays[1])
        return {"v": new, "w": arrays[1], "changed": new != arrays[0]}

    while True:
        w_kind = dict(df.dtypes)["w"]
        df, path = written(apply_blocks(df, shape, ["v", "w"], run, 1, {"v": kind, "w": w_kind, "changed": "boolean"}, block), "round")
        if last:
            remove(spark, last)
        last = path
        if df.where("changed").limit(1).count() == 0:
            return df.select("z", "y", "x", "v")
