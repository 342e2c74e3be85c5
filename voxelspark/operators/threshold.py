"""Global and local thresholds; local ones give 255 where a value exceeds its own threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stencils, weights
from ..plans.blocks import on_blocks
from ..plans.box import axis_pass
from ..volume import Volume
from .filters import _flat, smoothed
from .pointwise import above, rank_of_bins


def _moments(image: Volume, size: int, type3d: int, squares: bool) -> DataFrame:
    """own, the mean as m and, if asked for, the mean square as q."""
    df = image.df.select("z", "y", "x", F.col("v").cast("double").alias("own"), F.col("v").cast("double").alias("m"), (F.col("v").cast("double") ** 2).alias("q"))
    w = weights.flat(size)
    axes = "yx" if _flat(image, type3d) or size == 1 else "zyx"
    for axis in axes:
        if size > 1:
            outputs = {"m": ("m", w), **({"q": ("q", w)} if squares else {})}
            df = axis_pass(df, axis, image.shape["zyx".index(axis)], outputs, keep=("own",))
    count = size ** len(axes)
    return df.withColumn("m", F.col("m") / count).withColumn("q", F.col("q") / count if squares else F.lit(0.0))


@on_blocks(stencils.threshold_gaussian)
def threshold_gaussian(image: Volume, sigma: float = 1, weight: float = 0, type3d: int = 1, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1) -> Volume:
    """The window has ceil(6 sigma + 1) cells."""
    df = image.df.withColumn("v", F.col("v").cast("double")).withColumn("own", F.col("v"))
    df = smoothed(df, image.shape, sigma, weights.threshold_size(sigma), _flat(image, type3d), ("own",))
    return image.with_df(df.withColumn("v", above(F.col("own"), F.col("v") - weight)), "float32")


@on_blocks(stencils.threshold_mean)
def threshold_mean(image: Volume, windowSize: int = 3, weight: float = 0, type3d: int = 1, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1) -> Volume:
    df = _moments(image, windowSize, type3d, False)
    return image.with_df(df.withColumn("v", above(F.col("own"), F.col("m") - weight)), "float32")


def threshold_local(image: Volume, block_size: int = 3, sigma: float = 1, offset: float = 0, method: str = "gaussian", type3d: int = 1) -> Volume:
    if method == "gaussian":
        return threshold_gaussian(image, sigma, offset, type3d)
    if method == "mean":
        return threshold_mean(image, block_size, offset, type3d)
    raise ValueError(f"unknown method {method}: gaussian or mean")


def _deviation():
    return F.sqrt(F.greatest(F.col("q") - F.col("m") ** 2, F.lit(0.0)))


@on_blocks(stencils.threshold_niblack)
def threshold_niblack(image: Volume, windowSize: int = 3, weight: float = 0, type3d: int = 1, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1) -> Volume:
    """mean - weight * deviation."""
    df = _moments(image, windowSize, type3d, True)
    return image.with_df(df.withColumn("v", above(F.col("own"), F.col("m") - weight * _deviation())), "float32")


@on_blocks(stencils.threshold_sauvola)
def threshold_sauvola(image: Volume, windowSize: int = 3, weight: float = 0, range: float = 1, type3d: int = 1, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1) -> Volume:
    """mean * (1 + weight * (deviation / range - 1))."""
    df = _moments(image, windowSize, type3d, True)
    return image.with_df(df.withColumn("v", above(F.col("own"), F.col("m") * (1 + weight * (_deviation() / range - 1)))), "float32")


def histogram(image: Volume, nbins: int = 256) -> DataFrame:
    """(bin, cnt) of equal bins between the extremes; a constant image has one bin."""
    ends = image.df.agg(F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))
    v = F.col("v").cast("double")
    where = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(nbins - 1), F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * nbins)))
    return image.df.join(F.broadcast(ends)).groupBy(where.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def otsu(histogram_counts: DataFrame, nbins: int = 256) -> DataFrame:
    """(threshold): one more than the last bin that maximises the variance between the classes.
    Runs over the histogram, at most ``nbins`` rows."""
    below = rank_of_bins()
    everything = histogram_counts.agg(F.sum("cnt").alias("n"), F.sum(F.col("bin").cast("double") * F.col("cnt")).alias("total"))
    # empty bins have the variance of the bin before, and the last maximiser wins
    bins = histogram_counts.sparkSession.range(nbins).select(F.col("id").cast("int").alias("bin"))
    df = bins.join(histogram_counts, "bin", "left").fillna(0, ["cnt"]).join(F.broadcast(everything))
    df = df.withColumn("wb", F.sum("cnt").over(below)).withColumn("sb", F.sum(F.col("bin").cast("double") * F.col("cnt")).over(below))
    df = df.withColumn("wf", F.col("n") - F.col("wb")).where("wb > 0 and wf > 0")
    gap = F.col("sb") / F.col("wb") - (F.col("total") - F.col("sb")) / F.col("wf")
    df = df.withColumn("variance", F.col("wb").cast("double") * F.col("wf") * gap * gap)
    return df.agg(F.coalesce(F.max_by("bin", F.struct("variance", "bin")) + 1, F.lit(0)).cast("int").alias("threshold"))
