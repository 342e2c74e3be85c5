"""The volume: a lazy, immutable DataFrame of voxels with a known shape and element type.

Columns are ``z, y, x`` (int, from 0) and ``v``. A volume is dense: each cell occurs once.
Operators return new volumes; nothing is computed until an action, and voxels reach the driver
only through ``to_numpy``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types and the Spark types that hold them (Spark has no unsigned types).
SPARK_TYPES = {"float32": "float", "float64": "double", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "bool": "boolean"}


@dataclass(frozen=True)
class Volume:
    df: DataFrame
    shape: tuple[int, int, int]
    dtype: str = "float32"

    def __post_init__(self):
        if self.df is None or len(self.shape) != 3 or min(self.shape) < 1:
            raise ValueError(f"a volume has three axes of at least one cell, not {self.shape}")
        if self.dtype not in SPARK_TYPES:
            raise ValueError(f"unknown element type {self.dtype}")

    @classmethod
    def from_numpy(cls, spark: SparkSession, array: np.ndarray, dtype: str | None = None) -> Volume:
        """From an array of two (one slice) or three axes."""
        if array is None or array.size == 0 or array.ndim not in (2, 3):
            raise ValueError("an image has two or three axes and at least one cell")
        array = array[None] if array.ndim == 2 else array
        dtype = dtype or str(array.dtype)
        z, y, x = (i.ravel().astype(np.int32) for i in np.indices(array.shape))
        frame = pd.DataFrame({"z": z, "y": y, "x": x, "v": array.ravel()})
        df = spark.createDataFrame(frame).select(*(F.col(a).cast("int").alias(a) for a in "zyx"), F.col("v").cast(SPARK_TYPES[dtype]).alias("v"))
        return cls(df, array.shape, dtype)

    @classmethod
    def from_cells(cls, df: DataFrame, shape: tuple[int, int, int], dtype: str = "int32", fill: float = 0) -> Volume:
        """From some cells; the others get ``fill``. The grid is generated, not collected."""
        nz, ny, nx = shape
        i = F.col("id")
        grid = df.sparkSession.range(nz * ny * nx).select(F.expr(f"cast(id div {ny * nx} as int)").alias("z"), F.expr(f"cast(id div {nx} % {ny} as int)").alias("y"), (i % nx).cast("int").alias("x"))
        cells = df.select("z", "y", "x", "v")
        full = grid.join(cells, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("v", F.lit(fill)).cast(SPARK_TYPES[dtype]).alias("v"))
        return cls(full, tuple(shape), dtype)

    def to_numpy(self) -> np.ndarray:
        """Collect the volume to the driver; for volumes that fit there."""
        rows = self.df.select("z", "y", "x", "v").toPandas()
        out = np.zeros(self.shape, dtype=self.dtype)
        out[rows.z, rows.y, rows.x] = rows.v
        return out

    def with_df(self, df: DataFrame, dtype: str | None = None) -> Volume:
        """The same cells with new values, cast to the element type."""
        dtype = dtype or self.dtype
        return replace(self, df=df.select("z", "y", "x", F.col("v").cast(SPARK_TYPES[dtype]).alias("v")), dtype=dtype)

    def map(self, value: Column, dtype: str | None = None) -> Volume:
        """A pointwise expression of ``v``."""
        return self.with_df(self.df.withColumn("v", value), dtype)

    def zip(self, other: Volume, value: Column, dtype: str | None = None) -> Volume:
        """A pointwise expression of ``v`` and the other volume's ``w``."""
        if self.shape != other.shape:
            raise ValueError(f"shapes differ: {self.shape} and {other.shape}")
        return self.with_df(self.joined(other).withColumn("v", value), dtype)

    def joined(self, other: Volume, name: str = "w") -> DataFrame:
        return self.df.join(other.df.select("z", "y", "x", F.col("v").alias(name)), ["z", "y", "x"])

    def astype(self, dtype: str) -> Volume:
        return self.map(F.col("v"), dtype)

    def slices(self, first: int, last: int) -> Volume:
        """The slices first..last - 1, renumbered from 0. The predicate reaches the source."""
        if not 0 <= first < last <= self.shape[0]:
            raise ValueError(f"no slices {first}..{last} in {self.shape}")
        part = self.df.where((F.col("z") >= first) & (F.col("z") < last)).withColumn("z", F.col("z") - first)
        return Volume(part, (last - first, *self.shape[1:]), self.dtype)

    def map_blocks(self, kernel, halo=0, dtype: str | None = None, block=None) -> Volume:
        """A user kernel over blocks with a halo; see plans.halo."""
        from .plans.halo import map_blocks

        return map_blocks(self, kernel, halo, dtype=dtype, block=block)

    def map_slices(self, kernel, dtype: str | None = None) -> Volume:
        """A user kernel over single slices."""
        from .plans.halo import map_slices

        return map_slices(self, kernel, dtype=dtype)
