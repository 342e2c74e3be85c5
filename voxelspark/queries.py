"""One registered query for each operator, over volumes derived from whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import footprint as fp
from .functions import kernels
from .operators import features, filters, morphology, pointwise, quantification, restoration, segmentation, threshold
from .plans.blocks import pack, read_blocks
from .plans.box import AXES
from .sources.tables import embeddings_labels, embeddings_mask, embeddings_volume, lineitem_volume
from .streaming.slices import map_stream, pack_slices, unpack_slices
from .volume import Volume

Query = Callable[[SparkSession, str], DataFrame]
CUBE, SQUARE = fp.cube(1), fp.square()
#: Cells that match foreground, background or anything.
MIXED = fp.custom([[[1, -1, -1], [1, 1, -1], [-1, 0, -1]]])


def ints(volume: Volume) -> DataFrame:
    return volume.df.select(*AXES, F.round("v").cast("bigint").alias("v"))


def reals(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*AXES, *((F.round(F.col(n).cast("double"), 4) + 0.0).alias(n) for n in names))


def _of(make: Callable[[Volume], Volume], source: Callable = embeddings_volume, scale: float | None = None) -> Query:
    """The operator's integer result; ``scale`` multiplies it first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(source(spark, sf_dir))
        return ints(out if scale is None else out.map(F.col("v") * scale, "float64"))

    return run


def _real(make: Callable[[Volume], Volume]) -> Query:
    return lambda spark, sf_dir: reals(make(embeddings_volume(spark, sf_dir)).df, "v")


def _binary(make: Callable[[Volume], Volume], least: int = 0) -> Query:
    return lambda spark, sf_dir: ints(make(embeddings_mask(spark, sf_dir, least)))


def _two(make: Callable[[Volume, Volume], Volume]) -> Query:
    """The volume and its maximum over 3 x 3 x 3, as mask or second operand."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        image = embeddings_volume(spark, sf_dir)
        return ints(make(image, morphology.dilation(image, CUBE)))

    return run


def _masks(make: Callable[[Volume, Volume], Volume]) -> Query:
    """Masks of two thresholds, 100 and -50."""
    return lambda spark, sf_dir: ints(make(embeddings_mask(spark, sf_dir, 100), embeddings_mask(spark, sf_dir, -50)))


def _labels(make: Callable[[Volume], DataFrame], column: str) -> Query:
    return lambda spark, sf_dir: make(embeddings_labels(spark, sf_dir)).select(F.col("label").cast("bigint").alias("label"), F.col(column).cast("bigint").alias(column))


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = embeddings_volume(spark, sf_dir)
    other = morphology.closing(image, CUBE)
    return spark.createDataFrame([(pointwise.compare_arrays_grayscale(image, image), pointwise.compare_arrays_grayscale(image, other))], "same boolean, other boolean")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ints(embeddings_volume(spark, sf_dir).slices(2, 7))


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.histogram(embeddings_volume(spark, sf_dir)).select(F.col("bin").cast("bigint").alias("bin"), "cnt")


def _otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.otsu(threshold.histogram(embeddings_volume(spark, sf_dir))).select(F.col("threshold").cast("bigint").alias("threshold"))


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as labels: rare values go."""
    return ints(quantification.remove_islands(embeddings_volume(spark, sf_dir), 60))


def _labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ints(quantification.labelling(embeddings_mask(spark, sf_dir, 220)))


def _superpixels(image: Volume) -> Volume:
    """A grid of 10 x 8 pixels, the same in every slice."""
    df = image.df.withColumn("v", (F.floor(F.col("y") / 10) * 8 + F.floor(F.col("x") / 8)).cast("int"))
    return image.with_df(df, "int32")


def _pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = embeddings_volume(spark, sf_dir)
    wanted = {"Intensity": True, "LocalBinaryPattern": False, "pooling": {"output_mean": True, "output_min": True, "output_max": True}}
    df = features.superpixel_pooling_feature(image, _superpixels(image), [0.5], features=wanted)
    return df.select(F.col("sp_id").cast("bigint").alias("sp_id"), *(F.round(F.col(c).cast("double"), 1).alias(c) for c in df.columns[1:]))


def _pooling_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = embeddings_volume(spark, sf_dir)
    wanted = {"Intensity": True, "Edges": True, "Texture": True, "ShapeIndex": True, "LocalBinaryPattern": True, "pooling": {"output_mean": True}}
    return features.superpixel_pooling_feature(image, _superpixels(image), [1.0, 2.0], features=wanted)


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.pixel_feature_extract(embeddings_volume(spark, sf_dir), [1.0, 2.0])
    return df.select(*AXES, *(F.round(F.col("features")[i].cast("double"), 2).alias(n) for i, n in enumerate(features.feature_names([1.0, 2.0], features.DEFAULT_FEATURES))))


def _markers(spark: SparkSession, sf_dir: str) -> tuple[Volume, Volume]:
    """Two markers a slice, in opposite corners."""
    image = embeddings_volume(spark, sf_dir)
    ny, nx = image.shape[1:]
    corner = F.when((F.col("y") == 0) & (F.col("x") == 0), 1).when((F.col("y") == ny - 1) & (F.col("x") == nx - 1), 2).otherwise(0)
    return image, image.map(corner, "int32")


def _disc(image: Volume) -> Volume:
    inside = (F.col("y") - 25) ** 2 + (F.col("x") - 32) ** 2 <= 225
    return image.map(inside, "bool")


def _contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = embeddings_volume(spark, sf_dir)
    g = image.map(1 / (1 + F.abs(F.col("v")) / 100), "float32")
    return ints(segmentation.morphological_geodesic_active_contour(g, 10, _disc(image)).map(F.col("v").cast("int"), "int32"))


def _chan_vese(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = embeddings_volume(spark, sf_dir)
    return ints(segmentation.morphological_chan_vese(image, 10, _disc(image)).map(F.col("v").cast("int"), "int32"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form of a slice filter, over the packed slices as one batch."""
    packed = pack_slices(embeddings_volume(spark, sf_dir))
    return unpack_slices(map_stream(packed, kernels.lbp)).select(*AXES, F.round("v").cast("bigint").alias("v"))


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Erosion, local mean threshold, and the volume of what is left."""
    image = morphology.erosion(embeddings_volume(spark, sf_dir), CUBE)
    return quantification.compute_volume(threshold.threshold_mean(image, 3).astype("int32")).select(F.col("label").cast("bigint").alias("label"), "volume")


def _eigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reals(features.hessian_eigenvalues(embeddings_volume(spark, sf_dir)), "l1", "l2")


def _eigen_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reals(features.hessian_eigenvalues(embeddings_volume(spark, sf_dir), method="direct"), "l1", "l2")


def _hessian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reals(features.hessian(embeddings_volume(spark, sf_dir)), "fyy", "fxx", "fxy")


def _blocks(make: Callable[[Volume], Volume]) -> Query:
    """The operator's block form, over the packed volume."""
    return lambda spark, sf_dir: ints(make(pack(embeddings_volume(spark, sf_dir))))


def _raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as raw files, a file for each block, and read back as another type."""
    store = pack(embeddings_volume(spark, sf_dir)).store
    folder = store.files[0][4].rpartition("/")[0]
    return ints(read_blocks(spark, folder, store.shape, "int32", "float32", block=(3, 20)))


def _compare_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = embeddings_mask(spark, sf_dir, 100), embeddings_mask(spark, sf_dir, -50)
    return spark.createDataFrame([(pointwise.compare_arrays_binary(a, a), pointwise.compare_arrays_binary(a, b))], "same boolean, other boolean")


M, T, Q = morphology, threshold, quantification
QUERIES: dict[str, Query] = {
    "flagship": _flagship,
    # sources
    "source_table_volume": lambda spark, sf_dir: ints(lineitem_volume(spark, sf_dir)),
    "source_slice_range": _stored,
    "source_raw_round_trip": _raw_round_trip,
    # block forms
    "blocks_opening": _blocks(lambda v: morphology.opening(v, CUBE)),
    "blocks_gaussian": lambda spark, sf_dir: reals(filters.gaussian(pack(embeddings_volume(spark, sf_dir)), 1.0, dtype="float64").df, "v"),
    "blocks_median_3d": _blocks(lambda v: filters.median(v, 3, 3, 3)),
    "blocks_threshold_mean": _blocks(lambda v: threshold.threshold_mean(v, 3, 0.01)),
    "blocks_reconstruction": _blocks(lambda v: morphology.reconstruction(morphology.erosion(v, CUBE), v, "dilation")),
    # pointwise
    "compare_arrays_binary": _compare_binary,
    "complement_binary": _binary(pointwise.complement_binary),
    "logical_or": _masks(pointwise.logical_or),
    "subtraction": _two(pointwise.subtraction),
    "custom_abs": _of(pointwise.custom_abs),
    "compare_arrays": _compare,
    "binarize_slices": _of(pointwise.binarize_slices),
    "slice_crop": _of(lambda v: pointwise.crop(v, 4)),
    "dtype_cast": _of(lambda v: v.map(F.col("v") / 3, "float64").astype("int16")),
    "strict_threshold": _of(lambda v: v.map(pointwise.above(F.col("v"), F.lit(50)), "float32")),
    # filters
    "gaussian": _real(lambda v: filters.gaussian(v, 1.0, dtype="float64")),
    "gaussian_2d": _real(lambda v: filters.gaussian(v, 0.75, 0, dtype="float64")),
    "mean": _of(lambda v: filters.mean(v, 3, dtype="float64"), scale=27),
    "mean_2d": _of(lambda v: filters.mean(v, 4, 0, dtype="float64"), scale=16),
    "median": _of(lambda v: filters.median(v, 3, 3)),
    "median_3d": _of(lambda v: filters.median(v, 3, 3, 3)),
    "laplace": _of(lambda v: filters.laplace(v, dtype="float64")),
    "laplace_2d": _of(lambda v: filters.laplace(v, 0, dtype="float64")),
    "unsharp_mask": _real(lambda v: filters.unsharp_mask(v, 0.5, 1.5, 20.0, 0, dtype="float64")),
    "sobel": _of(lambda v: filters.sobel(v, dtype="float64").map(F.col("v") ** 2)),
    "sobel_2d": _of(lambda v: filters.sobel(v, 0, dtype="float64").map(F.col("v") ** 2)),
    "prewitt": _of(lambda v: filters.prewitt(v, dtype="float64").map(F.col("v") ** 2)),
    "prewitt_2d": _of(lambda v: filters.prewitt(v, 0, dtype="float64").map(F.col("v") ** 2)),
    "canny": _of(lambda v: filters.canny(v, 1.0, 200.0, 600.0)),
    "deriche": _of(lambda v: filters.deriche(v, 1.0, 200.0, 600.0)),
    "anisotropic_diffusion2D": _real(lambda v: restoration.anisotropic_diffusion2D(v.astype("float64"), 1, 0.1, 200.0, 2)),
    "anisotropic_diffusion3D": _real(lambda v: restoration.anisotropic_diffusion3D(v.astype("float64"), 1, 0.1, 200.0, 2)),
    "non_local_means": _real(lambda v: restoration.non_local_means(v, 3, 5, 200.0)),
    "anisotropic_diffusion3D_exponential": _real(lambda v: restoration.anisotropic_diffusion3D(v.astype("float64"), 2, 0.1, 200.0, 1)),
    "anisotropic_diffusion2D_tanh": _real(lambda v: restoration.anisotropic_diffusion2D(v.astype("float64"), 2, 0.1, 200.0, 3)),
    # thresholds
    "threshold_local_gaussian": _of(lambda v: T.threshold_local(v, 3, 0.5, 0.123, "gaussian")),
    "threshold_gaussian": _of(lambda v: T.threshold_gaussian(v, 0.5, 0.123)),
    "threshold_mean": _of(lambda v: T.threshold_mean(v, 3, 0.01)),
    "threshold_local": _of(lambda v: T.threshold_local(v, 5, offset=0.01, method="mean", type3d=0)),
    "threshold_niblack": _of(lambda v: T.threshold_niblack(v, 3, 0.2)),
    "threshold_sauvola": _of(lambda v: T.threshold_sauvola(v, 3, 0.2, 128.0)),
    "histogram": _histogram,
    "otsu": _otsu,
    # grey morphology
    "erosion": _of(lambda v: M.erosion(v, CUBE)),
    "dilation": _of(lambda v: M.dilation(v, CUBE)),
    "closing": _of(lambda v: M.closing(v, CUBE)),
    "opening": _of(lambda v: M.opening(v, CUBE)),
    "erosion_line": _of(lambda v: M.erosion(v, fp.line_h(4))),
    "erosion_line_v": _of(lambda v: M.erosion(v, fp.line_v(4))),
    "dilation_custom": _of(lambda v: M.dilation(v, MIXED)),
    "geodesic_erosion": _two(lambda v, mask: M.geodesic_erosion(mask, v)),
    "geodesic_dilation": _two(lambda v, mask: M.geodesic_dilation(v, mask)),
    "reconstruction": lambda spark, sf_dir: ints((lambda v: M.reconstruction(M.erosion(v, CUBE), v, "dilation"))(embeddings_volume(spark, sf_dir))),
    "white_tophat": _of(lambda v: M.white_tophat(v, CUBE)),
    "black_tophat": _of(lambda v: M.black_tophat(v, CUBE)),
    "white_tophat_reconstruction": _of(lambda v: M.white_tophat_reconstruction(v, CUBE)),
    "black_tophat_reconstruction": _of(lambda v: M.black_tophat_reconstruction(v, CUBE)),
    # binary morphology
    "binary_erosion": _binary(lambda v: M.binary_erosion(v, SQUARE)),
    "binary_dilation": _binary(lambda v: M.binary_dilation(v, SQUARE)),
    "binary_erosion_mixed": _binary(lambda v: M.binary_erosion(v, MIXED)),
    "binary_dilation_mixed": _binary(lambda v: M.binary_dilation(v, MIXED)),
    "binary_closing": _binary(lambda v: M.binary_closing(v, SQUARE)),
    "binary_opening": _binary(lambda v: M.binary_opening(v, SQUARE)),
    "binary_smoothing": _binary(lambda v: M.binary_smoothing(v, SQUARE)),
    "binary_geodesic_erosion": _masks(lambda a, b: M.binary_geodesic_erosion(b, a)),
    "binary_geodesic_dilation": _masks(lambda a, b: M.binary_geodesic_dilation(a, b)),
    "binary_reconstruction": lambda spark, sf_dir: ints(M.binary_reconstruction(embeddings_mask(spark, sf_dir, 300), embeddings_mask(spark, sf_dir, 150))),
    "fill_holes": _binary(M.fill_holes, -150),
    # segmentation
    "morphological_geodesic_active_contour": _contour,
    "morphological_chan_vese": _chan_vese,
    "watershed_meyers_2d": lambda spark, sf_dir: ints(segmentation.watershed_meyers_2d(*_markers(spark, sf_dir))),
    "watershed_meyers_3d": lambda spark, sf_dir: ints(segmentation.watershed_meyers_3d(*_markers(spark, sf_dir))),
    "snic_2d": _of(lambda v: segmentation.snic_2d(v, 8.0)),
    "snic_2d_batched": _of(lambda v: segmentation.snic_2d_batched(v, 8.0, dz=2)),
    "snic_3d": _of(lambda v: segmentation.snic_3d(v, 8.0)),
    "snic_3d_batched": _of(lambda v: segmentation.snic_3d_batched(v, 4.0, dz=5)),
    # quantification
    "compute_volume": _labels(Q.compute_volume, "volume"),
    "compute_area": _labels(Q.compute_area, "area"),
    "compute_surface": _labels(lambda v: Q.compute_area(v, True), "area"),
    "compute_perimeter": _labels(Q.compute_perimeter, "perimeter"),
    "compute_fraction": _labels(Q.compute_fraction, "fraction"),
    "labelling": _labelling,
    "labelling_relabelled": lambda spark, sf_dir: ints(quantification.labelling(embeddings_mask(spark, sf_dir, 220), relabel=True)),
    "remove_islands": _islands,
    "distance_transform_edt": lambda spark, sf_dir: reals(Q.distance_transform_edt(embeddings_mask(spark, sf_dir, 0)).df, "v"),
    # features
    "local_binary_pattern": _of(features.LBP),
    "local_binary_pattern_stream": _stream,
    "grad_rows": _of(lambda v: features.grad(v, 0, dtype="float64"), scale=2),
    "grad_columns": _of(lambda v: features.grad(v, 1, dtype="float64"), scale=2),
    "hessian": _hessian,
    "hessian_eigenvalues": _eigen,
    "hessian_eigenvalues_direct": _eigen_direct,
    "shape_index": _real(lambda v: features.shape_index(v, dtype="float64")),
    "pixel_feature_extract": _pixels,
    "superpixel_pooling_feature": _pooling,
    "superpixel_pooling_all": _pooling_all,
    # user kernels
    "map_blocks": _of(lambda v: v.map_blocks(lambda a: kernels.box_reduce(a, (3, 3, 3), True), 1, block=(4, 20, 32))),
    "map_slices": _of(lambda v: v.map_slices(lambda a: a - a.min())),
}
