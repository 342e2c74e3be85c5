"""Pointwise operators; each is one expression, fused by whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stencils
from ..plans.blocks import on_blocks
from ..volume import Volume


@on_blocks(stencils.complement_binary)
def complement_binary(image: Volume) -> Volume:
    return image.map(1 - F.col("v"))


def logical_or(a: Volume, b: Volume) -> Volume:
    return a.zip(b, ((F.col("v") != 0) | (F.col("w") != 0)).cast("int"), "int32")


def subtraction(a: Volume, b: Volume) -> Volume:
    """b minus a."""
    return a.zip(b, F.col("w") - F.col("v"))


@on_blocks(stencils.custom_abs)
def custom_abs(image: Volume) -> Volume:
    return image.map(F.abs("v"))


def compare_arrays(a: Volume, b: Volume, tolerance: float = 0.0) -> bool:
    """Are all values within ``tolerance``? One aggregate; integers compare exactly."""
    if a.shape != b.shape:
        return False
    worst = a.joined(b).agg(F.max(F.abs(F.col("v").cast("double") - F.col("w").cast("double")))).first()[0]
    return worst is not None and worst <= tolerance


def compare_arrays_binary(a: Volume, b: Volume) -> bool:
    return compare_arrays(a, b)


def compare_arrays_grayscale(a: Volume, b: Volume) -> bool:
    return compare_arrays(a, b, 1e-8)


def binarize_slices(image: Volume) -> Volume:
    """1 where a value reaches its slice's (min + max) // 2. The extremes are a small aggregate
    of one row a slice, joined back, so no slice has to fit a task."""
    ends = image.df.groupBy("z").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    df = image.df.join(ends, "z").withColumn("v", (F.col("v") >= F.floor((F.col("low") + F.col("high")) / 2)).cast("int"))
    return image.with_df(df, "int32")


def crop(image: Volume, slices: int) -> Volume:
    return image.slices(0, min(slices, image.shape[0]))


def astype(image: Volume, dtype: str) -> Volume:
    return image.astype(dtype)


def above(value, threshold):
    """255 where the value exceeds the threshold, else 0."""
    return F.when(value > threshold, F.lit(255.0)).otherwise(F.lit(0.0))


def rank_of_bins() -> Window:
    return Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
