"""Grey and binary morphology. Neighbours outside the volume are ignored.

A box is one window minimum or maximum an axis. Footprints with "don't care" cells, or binary ones
that ask for background, are joined with their few offsets and aggregated; the geodesic fixpoints
run block by block (plans.fixpoint).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import footprint as fp
from ..functions import kernels, stencils
from ..functions.hints import hinted
from ..plans import blocks
from ..plans.blocks import on_blocks
from ..plans.box import AXES, box
from ..plans.fixpoint import fixpoint
from ..volume import SPARK_TYPES, Volume


def _stencil(image: Volume, footprint: np.ndarray, value, agg):
    """Scatter each voxel to the cells that see it and aggregate there: the offsets are a literal
    array, so the product needs no join, and partial aggregates shrink it before the shuffle."""
    cells = F.array(*(F.struct(*(F.lit(c).alias(n) for c, n in zip(o, ("dz", "dy", "dx", "k"), strict=True))) for o in fp.offsets(footprint)))
    df = image.df.withColumn("o", F.explode(cells))
    df = df.select(*((F.col(a) - F.col(f"o.d{a}")).alias(a) for a in AXES), value.alias("v"))
    inside = F.lit(True)
    for a, n in zip(AXES, image.shape, strict=True):
        inside = inside & (F.col(a) >= 0) & (F.col(a) < n)
    return df.where(inside).groupBy(*AXES).agg(agg("v").alias("v"))


def _grey(image: Volume, footprint, agg) -> Volume:
    f = fp.custom(footprint)
    if fp.is_full(f):
        return image.with_df(box(image.df, f.shape, agg))
    if f[tuple(n // 2 for n in f.shape)] < 0:  # the centre always takes part
        f = f.copy()
        f[tuple(n // 2 for n in f.shape)] = 0
    return image.with_df(_stencil(image, f, F.col("v"), agg))


@on_blocks(stencils.erosion)
def erosion(image: Volume, footprint, out=None, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1) -> Volume:
    return _grey(image, footprint, F.min)


@on_blocks(stencils.dilation)
def dilation(image: Volume, footprint, out=None, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1) -> Volume:
    return _grey(image, footprint, F.max)


@on_blocks(stencils.closing)
@hinted
def closing(image: Volume, footprint, **hints) -> Volume:
    return erosion(dilation(image, footprint), footprint)


@on_blocks(stencils.opening)
@hinted
def opening(image: Volume, footprint, **hints) -> Volume:
    return dilation(erosion(image, footprint), footprint)


def _geodesic_box(image: Volume, agg):
    return image.with_df(box(image.df, kernels.geodesic_sizes(image.shape), agg))


@hinted
def geodesic_erosion(image: Volume, mask: Volume, **hints) -> Volume:
    return _geodesic_box(image, F.min).zip(mask, F.greatest("v", "w"))


@hinted
def geodesic_dilation(image: Volume, mask: Volume, **hints) -> Volume:
    return _geodesic_box(image, F.max).zip(mask, F.least("v", "w"))


def _erodes(method: str) -> bool:
    if method not in ("erosion", "dilation"):
        raise ValueError(f"unknown method {method}: erosion or dilation")
    return method == "erosion"


def reconstruction(image: Volume, mask: Volume, method: str = "dilation", out=None, verbose: int = 0, ngpus: int = -1, block=None) -> Volume:
    """The geodesic operator repeated until nothing changes."""
    erodes, sizes = _erodes(method), kernels.geodesic_sizes(image.shape)
    if isinstance(image, blocks.BlockVolume) and isinstance(mask, blocks.BlockVolume):
        return blocks.reconstruct(image, mask, erodes)
    df = fixpoint(image.joined(mask), image.shape, lambda v, w: kernels.reconstruct(v, w, sizes, erodes), SPARK_TYPES[image.dtype], block)
    return image.with_df(df)


def _minus(a: Volume, b: Volume) -> Volume:
    return a.zip(b, F.col("v") - F.col("w"))


@on_blocks(stencils.white_tophat)
@hinted
def white_tophat(image: Volume, footprint, **hints) -> Volume:
    return _minus(image, opening(image, footprint))


@on_blocks(stencils.black_tophat)
@hinted
def black_tophat(image: Volume, footprint, **hints) -> Volume:
    return _minus(closing(image, footprint), image)


@hinted
def white_tophat_reconstruction(image: Volume, footprint, block=None, **hints) -> Volume:
    return _minus(image, reconstruction(opening(image, footprint), image, "dilation", block=block))


@hinted
def black_tophat_reconstruction(image: Volume, footprint, block=None, **hints) -> Volume:
    return _minus(reconstruction(closing(image, footprint), image, "erosion", block=block), image)


# --- binary


def _binary(image: Volume, footprint, agg) -> Volume:
    """All (min) or any (max) of the footprint's cells match: a cell of value k asks for voxels of
    value k, so a cell of 0 asks for background."""
    f = fp.custom(footprint)
    hit = image.map((F.col("v") == 1).cast("int"), "int32")
    if (f == 1).all():
        return image.with_df(box(hit.df, f.shape, agg))
    df = _stencil(image, f, (F.col("v") == F.col("o.k")).cast("int"), agg)
    left = image.df.select(*AXES).join(df, list(AXES), "left")  # a cell that no footprint cell sees
    return image.with_df(left.withColumn("v", F.coalesce("v", F.lit(1 if agg is F.min else 0))))


@on_blocks(stencils.binary_erosion)
@hinted
def binary_erosion(image: Volume, footprint, **hints) -> Volume:
    return _binary(image, footprint, F.min)


@on_blocks(stencils.binary_dilation)
@hinted
def binary_dilation(image: Volume, footprint, **hints) -> Volume:
    return _binary(image, footprint, F.max)


@on_blocks(stencils.binary_closing)
@hinted
def binary_closing(image: Volume, footprint, **hints) -> Volume:
    return binary_erosion(binary_dilation(image, footprint), footprint)


@on_blocks(stencils.binary_opening)
@hinted
def binary_opening(image: Volume, footprint, **hints) -> Volume:
    return binary_dilation(binary_erosion(image, footprint), footprint)


@on_blocks(stencils.binary_smoothing)
@hinted
def binary_smoothing(image: Volume, footprint, **hints) -> Volume:
    return binary_closing(binary_opening(image, footprint), footprint)


@hinted
def binary_geodesic_erosion(image: Volume, mask: Volume, **hints) -> Volume:
    return geodesic_erosion(image.map((F.col("v") == 1).cast("int")), mask)


@hinted
def binary_geodesic_dilation(image: Volume, mask: Volume, **hints) -> Volume:
    return geodesic_dilation(image.map((F.col("v") == 1).cast("int")), mask)


@hinted
def binary_reconstruction(image: Volume, mask: Volume, method: str = "dilation", block=None, **hints) -> Volume:
    _erodes(method)
    return reconstruction(image, mask, method, block=block)


@hinted
def fill_holes(image: Volume, padding: int = 50, block=None, **hints) -> Volume:
    """Background that the volume's faces do not reach becomes foreground; an axis of one cell has
    no faces. Exact for any blocks; ``padding`` has no effect."""
    face = F.lit(False)
    for a, n in zip(AXES, image.shape, strict=True):
        if n > 1:
            face = face | (F.col(a) == 0) | (F.col(a) == n - 1)
    outside = (1 - F.col("v")).cast(SPARK_TYPES[image.dtype])
    df = image.df.select(*AXES, F.when(face, outside).otherwise(F.lit(0)).cast(SPARK_TYPES[image.dtype]).alias("v"), outside.alias("w"))
    sizes = kernels.geodesic_sizes(image.shape)
    reached = fixpoint(df, image.shape, lambda v, w: kernels.reconstruct(v, w, sizes, False), SPARK_TYPES[image.dtype], block)
    return image.with_df(reached.withColumn("v", 1 - F.col("v")))
