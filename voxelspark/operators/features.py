"""Derivatives, shape index, pixel features and their pooling over superpixels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.hints import hinted
from ..plans.box import AXES, over
from ..plans.halo import apply_blocks
from ..volume import Volume
from .filters import LBP, local_binary_pattern  # noqa: F401

#: What pixel_feature_extract computes when nothing is asked for.
DEFAULT_FEATURES = {"Intensity": True, "Edges": True, "Texture": True, "ShapeIndex": False, "LocalBinaryPattern": False}


def _slope(column: str, axis: str) -> Column:
    """Half the difference of the neighbours; at the ends the one-sided difference."""
    w = over(axis)
    ahead, back, own = F.lead(column).over(w), F.lag(column).over(w), F.col(column)
    return F.when(back.isNull(), ahead - own).when(ahead.isNull(), own - back).otherwise((ahead - back) / 2)


def _check(step: int) -> None:
    if step != 1:
        raise ValueError("only step 1 is defined")


@hinted
def grad(image: Volume, axis: int = 0, step: int = 1, dtype: str = "float32", **hints) -> Volume:
    """Axis 0: along rows (y); axis 1: along columns (x)."""
    _check(step)
    df = image.df.withColumn("v", F.col("v").cast("double"))
    return image.with_df(df.withColumn("v", _slope("v", "yx"[axis])), dtype)


@hinted
def hessian(image: Volume, step: int = 1, **hints) -> DataFrame:
    """Gradients of gradients: z, y, x, fyy (along rows twice), fxx (along columns twice), fxy.
    Windows of one axis share a shuffle: two for y, two for x."""
    _check(step)
    df = image.df.withColumn("v", F.col("v").cast("double"))
    df = df.withColumn("fy", _slope("v", "y"))
    df = df.withColumn("fyy", _slope("fy", "y"))
    df = df.withColumns({"fx": _slope("v", "x"), "fxy": _slope("fy", "x")})
    df = df.withColumn("fxx", _slope("fx", "x"))
    return df.select(*AXES, "fyy", "fxx", "fxy")


@hinted
def hessian_eigenvalues(image: Volume, step: int = 1, method: str = "gradient", **hints) -> DataFrame:
    """z, y, x, l1 >= l2; ``method="direct"`` takes second differences instead of gradients of
    gradients, which differ near the border."""
    if method == "direct":
        _check(step)

        def run(arrays, _):
            both = [kernels.hessian_eigenvalues(a.astype(np.float64)) for a in arrays[0]]
            return {"l1": np.stack([b[0] for b in both]), "l2": np.stack([b[1] for b in both])}

        return apply_blocks(image.df, image.shape, ["v"], run, 0, {"l1": "double", "l2": "double"}, (1, *image.shape[1:]))
    a, d, b = F.col("fyy"), F.col("fxx"), F.col("fxy")
    root = F.sqrt((a - d) ** 2 + 4 * b * b)
    return hessian(image, step).select(*AXES, ((a + d + root) / 2).alias("l1"), ((a + d - root) / 2).alias("l2"))


@hinted
def shape_index(image: Volume, eigen: DataFrame | None = None, step: int = 1, dtype: str = "float32", **hints) -> Volume:
    """2 / pi * atan((l2 + l1) / (l2 - l1)); 0 where both are equal."""
    eigen = hessian_eigenvalues(image, step) if eigen is None else eigen
    l1, l2 = F.greatest("l1", "l2"), F.least("l1", "l2")
    value = F.when(l2 == l1, F.lit(0.0)).otherwise(2 / np.pi * F.atan((l2 + l1) / (l2 - l1)))
    return image.with_df(eigen.withColumn("v", value), dtype)


def feature_names(sigmas: Sequence[float], features: Mapping[str, bool]) -> list[str]:
    one = [n for key, names in (("Intensity", ["intensity"]), ("Edges", ["edges"]), ("Texture", ["texture1", "texture2"]), ("ShapeIndex", ["shape_index"]), ("LocalBinaryPattern", ["lbp"])) if features.get(key) for n in names]
    return [f"{n}_{i}" for i in range(len(sigmas)) for n in one]


@hinted
def pixel_feature_extract(image: Volume, sigmas: Sequence[float], features: Mapping[str, bool] | None = None, use_3d: bool = False, **hints) -> DataFrame:
    """z, y, x, features array<float>: for each sigma the wanted features of the smoothed slice.
    One array kernel computes them all from one read of the slice; ``use_3d`` has no effect."""
    wanted = dict(DEFAULT_FEATURES if features is None else features)
    sigmas = [float(s) for s in sigmas]

    def run(arrays, _):
        return {"features": np.stack([kernels.pixel_features(a, sigmas, wanted) for a in arrays[0]])}

    return apply_blocks(image.df, image.shape, ["v"], run, 0, {"features": "array<float>"}, (1, *image.shape[1:]))


@hinted
def superpixel_pooling_feature(image: Volume, superpixels: Volume, sigmas: Sequence[float], numSuperpixels: int = -1, features: Mapping | None = None, **hints) -> DataFrame:
    """(sp_id, f0, f1, ...): features pooled over superpixels, in the order sigma, feature, (mean,
    min, max). Partial aggregates before the shuffle; a superpixel without voxels gets 0."""
    features = {**DEFAULT_FEATURES, "pooling": {"output_mean": True}} if features is None else features
    pooling = features.get("pooling", {})
    kinds = [f for key, f in (("output_mean", F.avg), ("output_min", F.min), ("output_max", F.max)) if pooling.get(key)]
    if not kinds:
        raise ValueError("at least one of output_mean, output_min, output_max is needed")
    wanted = {k: v for k, v in features.items() if k != "pooling"}
    n = len(feature_names(sigmas, wanted))
    pixels = pixel_feature_extract(image, sigmas, wanted).join(superpixels.df.select(*AXES, F.col("v").alias("sp_id")), list(AXES)).where("sp_id >= 0")
    columns = [kind(F.col("features")[i].cast("double")).cast("float").alias(f"f{i * len(kinds) + j}") for i in range(n) for j, kind in enumerate(kinds)]
    pooled = pixels.groupBy("sp_id").agg(*columns)
    if numSuperpixels < 0:
        numSuperpixels = int(superpixels.df.agg(F.max("v")).first()[0]) + 1
    every = image.df.sparkSession.range(numSuperpixels).select(F.col("id").cast("int").alias("sp_id"))
    return every.join(pooled, "sp_id", "left").fillna(0.0)
