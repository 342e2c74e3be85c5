"""Kernels over blocks with a halo, as grouped Arrow functions.

The volume is cut into blocks. A voxel goes to its own block and to those whose halo holds it (one
shuffle of the volume plus halos); a numpy kernel then sees each block as a dense array and the
block's core is kept. At the volume's border the halo is cut off, so a kernel's own boundary rule
acts exactly there, and results do not depend on the cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..volume import SPARK_TYPES, Volume
from .box import AXES

BLOCK = (32, 128, 128)
_ARROW = {"float": pa.float32(), "double": pa.float64(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64())}


def _halos(halo: int | Sequence[int]) -> tuple[int, int, int]:
    return (halo,) * 3 if isinstance(halo, int) else tuple(halo)


def deal(df: DataFrame, shape: Sequence[int], halo: Sequence[int], block: Sequence[int]) -> DataFrame:
    """Copies of each voxel for the blocks that need it: columns bz, by, bx."""
    for axis, n, h, b in zip(AXES, shape, halo, block, strict=True):
        name = f"b{axis}"
        if b >= n:
            df = df.withColumn(name, F.lit(0))
        elif h == 0:
            df = df.withColumn(name, F.floor(F.col(axis) / b).cast("int"))
        else:
            low = F.floor(F.greatest(F.col(axis) - h, F.lit(0)) / b).cast("int")
            high = F.floor(F.least(F.col(axis) + h, F.lit(n - 1)) / b).cast("int")
            df = df.withColumn(name, F.explode(F.sequence(low, high)))
    return df


def apply_blocks(df: DataFrame, shape: Sequence[int], columns: Sequence[str], kernel: Callable, halo: int | Sequence[int], types: dict[str, str], block: Sequence[int] | None = None) -> DataFrame:
    """Run ``kernel(arrays, origin) -> {name: array}`` over blocks.

    arrays: one dense array for each of ``columns``, halo included; origin: the volume's
    coordinates of their first cell. The outputs have the arrays' shape (with a further axis for
    array types); their cores come back as rows z, y, x and ``types``' columns."""
    halo = _halos(halo)
    block = tuple(min(b, n) for b, n in zip(block or BLOCK, shape, strict=True))
    columns, types = tuple(columns), dict(types)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = [np.asarray(table.column(a)) for a in AXES]
        core = [int(k.as_py()) * b for k, b in zip(key, block, strict=True)]
        stop = [min(n, c + b) for n, c, b in zip(shape, core, block, strict=True)]
        low = [max(0, c - h) for c, h in zip(core, halo, strict=True)]
        high = [min(n, s + h) for n, s, h in zip(shape, stop, halo, strict=True)]
        size = [h - c for h, c in zip(high, low, strict=True)]
        where = tuple(a - c for a, c in zip(at, low, strict=True))
        arrays = []
        for c in columns:
            values = table.column(c).to_numpy()
            dense = np.zeros(size, values.dtype if values.dtype != object else bool)
            dense[where] = values
            arrays.append(dense)
        out = kernel(arrays, tuple(low))
        inner = tuple(slice(c - o, s - o) for c, s, o in zip(core, stop, low, strict=True))
        grid = np.meshgrid(*(np.arange(c, s, dtype=np.int32) for c, s in zip(core, stop, strict=True)), indexing="ij")
        rows = {a: pa.array(g.ravel()) for a, g in zip(AXES, grid, strict=True)}
        for name, kind in types.items():
            values = out[name][inner]
            if kind.startswith("array"):
                rows[name] = pa.array(list(values.reshape(-1, values.shape[-1])), _ARROW[kind])
            else:
                rows[name] = pa.array(values.ravel().astype(_ARROW[kind].to_pandas_dtype()), _ARROW[kind])
        return pa.table(rows)

    schema = "z int, y int, x int, " + ", ".join(f"{n} {t}" for n, t in types.items())
    dealt = deal(df.select(*AXES, *columns), shape, halo, block)
    return dealt.groupBy("bz", "by", "bx").applyInArrow(run, schema)


def map_blocks(volume: Volume, kernel: Callable[[np.ndarray], np.ndarray], halo: int | Sequence[int] = 0, dtype: str | None = None, block: Sequence[int] | None = None) -> Volume:
    """A kernel array -> array of the same shape, over blocks with a halo."""
    dtype = dtype or volume.dtype
    out = apply_blocks(volume.df, volume.shape, ["v"], lambda a, _: {"v": kernel(a[0])}, halo, {"v": SPARK_TYPES[dtype]}, block)
    return Volume(out, volume.shape, dtype)


def map_slices(volume: Volume, kernel: Callable[[np.ndarray], np.ndarray], dtype: str | None = None) -> Volume:
    """A kernel over each slice (an array of two axes) by itself."""
    return map_blocks(volume, lambda a: np.stack([kernel(s) for s in a]), 0, dtype, (1, *volume.shape[1:]))


def map_whole(volume: Volume, kernel: Callable, others: Sequence[Volume] = (), dtype: str | None = None, depth: int | None = None) -> Volume:
    """A sequential kernel over the whole volume, or over batches of ``depth`` slices, in one task
    each: for algorithms whose order of steps is global. ``others`` are joined by cell."""
    dtype = dtype or volume.dtype
    df, columns = volume.df, ["v"]
    for i, other in enumerate(others):
        if other.shape != volume.shape:
            raise ValueError(f"shapes differ: {volume.shape} and {other.shape}")
        df = df.join(other.df.select(*AXES, F.col("v").alias(f"w{i}")), list(AXES))
        columns.append(f"w{i}")
    block = (depth or volume.shape[0], *volume.shape[1:])
    out = apply_blocks(df, volume.shape, columns, lambda a, origin: {"v": kernel(*a, origin=origin)}, 0, {"v": SPARK_TYPES[dtype]}, block)
    return Volume(out, volume.shape, dtype)
