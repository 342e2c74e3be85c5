"""Volumes as Parquet, and results as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..volume import Volume


def write_volume(volume: Volume, path: str, slab: int = 16, mode: str = "overwrite") -> None:
    """One directory for each slab of slices, sorted inside, NaN stored as 0: a range of z then
    prunes directories and row groups."""
    v = F.nanvl(F.col("v"), F.lit(0)).alias("v") if volume.dtype.startswith("float") else F.col("v")
    df = volume.df.select("z", "y", "x", v, F.floor(F.col("z") / slab).cast("int").alias("slab"))
    df.repartition("slab").sortWithinPartitions("slab", "z", "y", "x").write.mode(mode).partitionBy("slab").parquet(path)


def read_volume(spark: SparkSession, path: str, shape: tuple[int, int, int], dtype: str = "float32", slab: int = 16, first: int = 0, last: int | None = None) -> Volume:
    """The slices first..last - 1 of a stored volume."""
    df = spark.read.parquet(path)
    last = shape[0] if last is None else last
    df = df.where((F.col("slab") >= first // slab) & (F.col("slab") <= (last - 1) // slab))
    whole = Volume(df.select("z", "y", "x", "v"), tuple(shape), dtype)
    return whole if (first, last) == (0, shape[0]) else whole.slices(first, last)


def append_results(results: DataFrame, path: str) -> None:
    """Add rows to a CSV table of measurements."""
    results.write.mode("append").option("header", True).csv(path)
