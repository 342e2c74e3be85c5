"""Slice-wise operators over a stream of slices.

Whole slices arrive as rows (z, height, width, data array<float>, row-major); each is filtered by
itself, so the query keeps no state and needs no watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..volume import Volume

SCHEMA = "z int, height int, width int, data array<float>"


def pack_slices(volume: Volume) -> DataFrame:
    """One row for each slice."""
    _, ny, nx = volume.shape
    rows = volume.df.groupBy("z").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col("v").cast("float").alias("v")))).alias("c"))
    return rows.select("z", F.lit(ny).alias("height"), F.lit(nx).alias("width"), F.transform("c", lambda c: c["v"]).alias("data"))


def unpack_slices(slices: DataFrame) -> DataFrame:
    """Voxel rows z, y, x, v of packed slices."""
    df = slices.select("z", "width", F.posexplode("data").alias("i", "v"))
    return df.select("z", F.expr("cast(i div width as int)").alias("y"), F.expr("cast(i % width as int)").alias("x"), "v")


def map_stream(slices: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a slice kernel (functions.kernels) to each packed slice, streaming or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, data in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "data")), strict=True):
                out.append(np.asarray(kernel(np.asarray(data, np.float64).reshape(h, w)), np.float32).ravel())
            yield pa.record_batch([batch.column("z"), batch.column("height"), batch.column("width"), pa.array(out, pa.list_(pa.float32()))], names=["z", "height", "width", "data"])

    return slices.mapInArrow(run, SCHEMA)
