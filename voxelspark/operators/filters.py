"""Smoothing and edge filters.

Separable filters are chained window passes (plans.box), one shuffle an axis; at the border they
mirror as described there. ``type3d=0`` or a single slice works slice by slice. The hints
``verbose``, ``gpuMemory`` and ``ngpus`` are accepted and have no effect. Sums are double; ``dtype`` is
the result's type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels, stencils, weights
from ..plans.blocks import on_blocks
from ..plans.box import axis_pass, neighbours, over, pad, reach, separable
from ..plans.halo import map_blocks, map_slices
from ..volume import Volume


#: Cells of a median window from which blocks carry less than windows do.
BLOCK_MEDIAN = 27


def _flat(image: Volume, type3d: int) -> bool:
    return type3d == 0 or image.shape[0] == 1


def _double(image: Volume):
    return image.df.withColumn("v", F.col("v").cast("double"))


def smoothed(df, shape, sigma: float, size: int, flat: bool, keep=()):
    """The Gaussian mean of column v."""
    w = weights.gaussian(sigma, size)
    return separable(df, shape, [None if flat else w, w, w], keep=keep)


@on_blocks(stencils.gaussian)
def gaussian(image: Volume, sigma: float = 1, type3d: int = 1, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1, dtype: str = "float32") -> Volume:
    """Weights exp(-d^2 / (2 sigma^2)) over ceil(4 sigma + 0.5) cells; the result of the 3-D form
    is its absolute value."""
    out = image.with_df(smoothed(_double(image), image.shape, sigma, weights.filter_size(sigma), _flat(image, type3d)), dtype)
    return out if _flat(image, type3d) else out.map(F.abs("v"))


@on_blocks(stencils.mean)
def mean(image: Volume, windowSize: int = 3, type3d: int = 1, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1, dtype: str = "float32") -> Volume:
    w = weights.flat(windowSize)
    axes = 2 if _flat(image, type3d) or windowSize == 1 else 3
    df = separable(_double(image), image.shape, [w if axes == 3 else None, w, w])
    return image.with_df(df.withColumn("v", F.col("v") / windowSize**axes), dtype)


@on_blocks(stencils.median)
def median(image: Volume, nx: int = 1, ny: int = 1, nz: int = 1, strategy: str | None = None) -> Volume:
    """nx rows by ny columns (by nz slices). ``strategy="window"`` gathers the values in windows and
    sorts them inside the JVM; ``"block"`` runs an array kernel on blocks with a halo, in one
    shuffle, and is the choice from ``BLOCK_MEDIAN`` cells on."""
    sizes = (nz, nx, ny)
    strategy = strategy or ("block" if nx * ny * nz >= BLOCK_MEDIAN else "window")
    if strategy == "block":
        return map_blocks(image, lambda a: kernels.median(a, sizes), [s // 2 + 1 for s in sizes])
    df = image.df.withColumn("v", F.array("v"))
    for axis, n, size in zip("zyx", image.shape, sizes, strict=True):
        if size > 1:
            low, high = reach(size)
            df = pad(df, axis, n, low, high)
            df = df.withColumn("v", F.flatten(F.collect_list("v").over(over(axis).rowsBetween(-low, high))))
            df = df.where((F.col(axis) >= 0) & (F.col(axis) < n))
    count = nx * ny * nz
    s = F.array_sort("v")
    middle = F.element_at(s, count // 2 + 1)
    if count % 2 == 0:
        middle = (middle + F.element_at(s, count // 2)) / 2
        middle = middle if image.dtype.startswith("float") else F.when(middle < 0, F.ceil(middle)).otherwise(F.floor(middle))
    return image.with_df(df.withColumn("v", middle))


@on_blocks(stencils.laplace)
def laplace(image: Volume, type3d: int = 1, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1, dtype: str = "float32") -> Volume:
    """Six (four) times the centre minus the face neighbours. Each axis adds its own term, so one
    pass an axis suffices."""
    df = _double(image).withColumn("s", F.lit(0.0))
    for axis, n in zip("zyx", image.shape, strict=True):
        if axis == "z" and _flat(image, type3d):
            continue
        df = axis_pass(df, axis, n, {"d": ("v", {-1: -1.0, 0: 2.0, 1: -1.0}), "c": ("v", {0: 1.0}), "t": ("s", {0: 1.0})})
        df = df.select("z", "y", "x", F.col("c").alias("v"), (F.col("t") + F.col("d")).alias("s"))
    return image.with_df(df.withColumn("v", F.col("s")), dtype)


@on_blocks(stencils.unsharp_mask)
def unsharp_mask(image: Volume, radius: float = 1, ammount: float = 1, threshold: float = 0, type3d: int = 1, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1, dtype: str = "float32") -> Volume:
    """Add ``ammount`` of the difference from the Gaussian mean where it reaches ``threshold``.
    The original value travels through the passes, so there is no join."""
    df = smoothed(_double(image).withColumn("own", F.col("v")), image.shape, radius, weights.filter_size(radius), _flat(image, type3d), ("own",))
    smooth = F.col("v") if _flat(image, type3d) else F.abs("v")
    t = F.col("own") - smooth
    return image.with_df(df.withColumn("v", F.when(F.abs(t) >= threshold, F.col("own") + ammount * t).otherwise(F.col("own"))), dtype)


def _gradient(image: Volume, smooth: dict[int, float], type3d: int, dtype: str) -> Volume:
    """Length of the smoothed difference vector. Passes carry what the later axes need, so all
    components share one shuffle an axis."""
    df, nz, ny, nx = _double(image), *image.shape
    if _flat(image, type3d):
        df = axis_pass(df, "y", ny, {"s": ("v", smooth), "d": ("v", weights.DIFF)})
        df = axis_pass(df, "x", nx, {"gx": ("s", weights.DIFF), "gy": ("d", smooth)})
        squares = F.col("gx") ** 2 + F.col("gy") ** 2
    else:
        df = axis_pass(df, "z", nz, {"s": ("v", smooth), "d": ("v", weights.DIFF)})
        df = axis_pass(df, "y", ny, {"ss": ("s", smooth), "sd": ("s", weights.DIFF), "ds": ("d", smooth)})
        df = axis_pass(df, "x", nx, {"gx": ("ss", weights.DIFF), "gy": ("sd", smooth), "gz": ("ds", smooth)})
        squares = F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2
    return image.with_df(df.withColumn("v", F.sqrt(squares)), dtype)


@on_blocks(stencils.sobel)
def sobel(image: Volume, type3d: int = 1, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1, dtype: str = "float32") -> Volume:
    return _gradient(image, weights.SMOOTH, type3d, dtype)


@on_blocks(stencils.prewitt)
def prewitt(image: Volume, type3d: int = 1, verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1, dtype: str = "float32") -> Volume:
    return _gradient(image, weights.FLAT, type3d, dtype)


@on_blocks(stencils.canny)
def canny(image: Volume, sigma: float = 1, low: float = 0.1, high: float = 0.3) -> Volume:
    """Slice by slice: eight dependent neighbourhoods in one array kernel, with one shuffle."""
    return map_slices(image, lambda a: kernels.canny(a, sigma, low, high), "float32")


@on_blocks(stencils.deriche)
def deriche(image: Volume, alpha: float = 1, low: float = 0.1, high: float = 0.3) -> Volume:
    return map_slices(image, lambda a: kernels.deriche(a, alpha, low, high), "float32")


@on_blocks(stencils.local_binary_pattern)
def local_binary_pattern(image: Volume) -> Volume:
    """Bit 7 - k is set when the k-th of eight neighbours, clockwise from the upper left, is
    greater than the centre."""
    around = ["n_m_m", "n_m_0", "n_m_p", "n_0_p", "n_p_p", "n_p_0", "n_p_m", "n_0_m"]
    code = sum((F.when(F.col(c) > F.col("n_0_0"), 1 << (7 - k)).otherwise(0) for k, c in enumerate(around)), F.lit(0))
    return image.with_df(neighbours(image.df, image.shape).withColumn("v", code), "float32")


LBP = local_binary_pattern
