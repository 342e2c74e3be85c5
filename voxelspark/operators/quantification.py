"""Measures of label images: partial and final aggregates of (label, value) rows."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.box import AXES, box
from ..plans.fixpoint import fixpoint
from ..plans.halo import map_whole
from ..plans.scratch import written
from ..volume import Volume


#: Parts into which the voxels of one label are dealt when labels are looked up.
SALTS = 16


def _lookup(df: DataFrame, table: DataFrame) -> DataFrame:
    """Left join on ``v`` with a table of one row a label. One label may hold most voxels, so each
    label's voxels are dealt to SALTS keys and the table is repeated for them."""
    salted = table.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salt = F.pmod(F.hash("z", "y"), F.lit(SALTS)).alias("salt")
    return df.select("*", salt).join(salted, ["v", "salt"], "left").drop("salt")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.col("v").alias("label")).agg(F.count(F.lit(1)).alias(name))


def compute_volume(image: Volume) -> DataFrame:
    """Voxels of each label, the background's included."""
    return _count(image.df, "volume")


def _boundary(image: Volume, axes: str) -> DataFrame:
    """Voxels at the volume's border on these axes or beside another label."""
    sizes = [3 if a in axes else 1 for a in AXES]
    df = image.df.withColumns({"low": F.col("v"), "high": F.col("v")})
    df = box(box(df, sizes, F.min, ["low"]), sizes, F.max, ["high"])
    edge = F.col("low") != F.col("high")
    for a, n in zip(AXES, image.shape, strict=True):
        if a in axes:
            edge = edge | (F.col(a) == 0) | (F.col(a) == n - 1)
    return df.where(edge)


def compute_area(image: Volume, type: bool = False) -> DataFrame:
    """Voxels of each label, or with ``type`` those on its surface (26 neighbours, and the
    volume's faces)."""
    return _count(_boundary(image, "zyx") if type else image.df, "area")


def compute_perimeter(image: Volume) -> DataFrame:
    """In each slice: voxels at the image border or with another label among eight neighbours."""
    return _count(_boundary(image, "yx"), "perimeter")


def compute_fraction(image: Volume) -> DataFrame:
    """Whole percent of the volume that each label takes. The total is the shape's product, so no
    second aggregate is needed."""
    total = image.shape[0] * image.shape[1] * image.shape[2]
    counts = _count(image.df, "n")
    return counts.select("label", F.floor(100 * F.col("n") / total).cast("long").alias("fraction"))


def _ranked(roots: DataFrame) -> DataFrame:
    """(v, r): the rows numbered from 1 in order. Ranges of v are numbered each in its own task,
    from the sum of the sizes of the ranges before, one row a range."""
    ranged, _ = written(roots.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "roots")
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    before = list(itertools.accumulate((counts[p] for p in sorted(counts)), initial=0))
    offsets = ranged.sparkSession.createDataFrame(list(zip(sorted(counts), before, strict=False)), "part int, before long")
    own = F.row_number().over(Window.partitionBy("part").orderBy("v"))
    return ranged.withColumn("own", own).join(F.broadcast(offsets), "part").select("v", (F.col("own") + F.col("before")).alias("r"))


def labelling(image: Volume, relabel: bool = False, block=None) -> Volume:
    """Connected parts of the non-zero voxels, 26 neighbours (eight in a single slice): the label
    is one more than the smallest voxel index; ``relabel`` counts them 1, 2, ... instead."""
    nz, ny, nx = image.shape
    index = F.when(F.col("v") != 0, (F.col("z").cast("long") * ny + F.col("y")) * nx + F.col("x") + 1).otherwise(F.lit(0).cast("long"))
    df = image.df.select(*AXES, index.alias("v"), (F.col("v") != 0).alias("w"))
    df = fixpoint(df, image.shape, kernels.spread_labels, "bigint", block)
    if relabel:
        rank = _ranked(df.where("v > 0").select("v").distinct())
        df = _lookup(df, rank).select(*AXES, F.coalesce("r", F.lit(0)).alias("v"))
    return Volume(df, image.shape, "uint32").with_df(df, "uint32")


def remove_islands(image: Volume, threshold: int) -> Volume:
    """Zero the voxels of labels with fewer than ``threshold`` voxels. The counts are pre-aggregated;
    only the small labels, at most threshold - 1 voxels each, are looked up."""
    small = image.df.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < threshold).select("v", F.lit(True).alias("small"))
    df = _lookup(image.df, small)
    return image.with_df(df.withColumn("v", F.when(F.col("small"), F.lit(0)).otherwise(F.col("v"))))


removeIslands = remove_islands


def distance_transform_logsum(image: Volume, lmbd: float = 1e-3, thresh: float = 1, verbose: int = 0) -> Volume:
    """A log-sum approximation of the distance transform, periodic at the borders; the transform is
    global, so one task takes the volume."""
    return map_whole(image, lambda a, origin: kernels.distance_logsum(a, lmbd, thresh), dtype="float32")


distance_transform_edt = distance_transform_logsum
parallel_fftfreq = kernels.fft_frequencies
