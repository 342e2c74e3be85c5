"""Headerless little-endian volumes as a Spark data source, ``format("rawvolume")``.

Options: path, nz, ny, nx, dtype (of the file). One input partition for each slab of ``slab``
slices; the reader maps the file and touches its own slab only. Filters on z prune slabs before
they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..volume import SPARK_TYPES, Volume

DTYPES = {"uint16": "uint16", "int16": "int16", "int32": "int32", "uint32": "uint32", "float32": "float32", "float64": "float64"}


class Slab(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class RawVolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.shape = tuple(int(options[k]) for k in ("nz", "ny", "nx"))
        self.kind = np.dtype(DTYPES[options.get("dtype", "float32")]).newbyteorder("<")
        self.slab = int(options.get("slab", 16))
        self.low, self.high = 0, self.shape[0]

    def pushFilters(self, filters):
        """Comparisons of z bound the slabs; all filters are applied again by Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("z",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[Slab]:
        if self.low >= self.high:
            return [Slab(0, 0)]
        return [Slab(z, min(z + self.slab, self.high)) for z in range(self.low, self.high, self.slab)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        nz, ny, nx = self.shape
        data = np.memmap(self.path, self.kind, "r")
        if data.size < nz * ny * nx:
            raise ValueError(f"{self.path} has {data.size} values, {nz * ny * nx} are needed")
        y, x = (i.ravel().astype(np.int32) for i in np.indices((ny, nx)))
        for z in range(partition.first, partition.last):
            values = np.asarray(data[z * ny * nx : (z + 1) * ny * nx])
            wide = {"uint16": np.int32, "uint32": np.int64}.get(self.kind.name, values.dtype.newbyteorder("="))
            yield pa.record_batch({"z": pa.array(np.full(ny * nx, z, np.int32)), "y": pa.array(y), "x": pa.array(x), "v": pa.array(values.astype(wide))})


class RawVolume(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvolume"

    def schema(self) -> str:
        return f"z int, y int, x int, v {SPARK_TYPES[DTYPES[self.options.get('dtype', 'float32')]]}"

    def reader(self, schema) -> RawVolumeReader:
        return RawVolumeReader(self.options)


def read_raw(spark: SparkSession, path: str, shape: tuple[int, int, int], dtype: str = "float32", slab: int = 16) -> Volume:
    """A volume of a raw file, of the file's element type."""
    spark.dataSource.register(RawVolume)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    nz, ny, nx = shape
    df = spark.read.format("rawvolume").options(path=path, nz=nz, ny=ny, nx=nx, dtype=dtype, slab=slab).load()
    return Volume(df, tuple(shape), dtype)
