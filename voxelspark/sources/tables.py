"""Volumes derived from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..volume import Volume

EMB_SLICE = (50, 64)
LI_SHAPE = (7, 64, 64)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame | None, tuple[int, int, int]]:
    """All vectors, the ids that their slices lack (None if there are none) and the volume's shape.
    The largest id gives the number of slices; an empty table is an empty volume of one slice."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ny, nx = EMB_SLICE
    last, count = df.agg(F.max("vec_id"), F.count("vec_id")).first()
    nz = 1 if last is None else last // ny + 1
    lacking = None if count in (0, nz * ny) else spark.range(nz * ny).withColumnRenamed("id", "vec_id").join(df, "vec_id", "left_anti")
    return df, lacking, (nz, ny, nx)


def _filled(df: DataFrame, lacking: DataFrame | None) -> DataFrame:
    """(vec_id, x, v) as voxels; a lacking vector's cells are 0."""
    if lacking is not None:
        df = df.unionByName(lacking.select("vec_id", _positions(), F.lit(0).alias("v")))
    z, y = F.expr(f"cast(vec_id div {EMB_SLICE[0]} as int)").alias("z"), F.expr(f"cast(vec_id % {EMB_SLICE[0]} as int)").alias("y")
    return df.select(z, y, "x", "v")


def _positions() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(EMB_SLICE[1] - 1))).alias("x")


def embeddings_volume(spark: SparkSession, sf_dir: str) -> Volume:
    """Row = vector, column = position, 50 vectors a slice, all vectors; thousandths, rounded down.
    Vectors that a slice lacks are 0."""
    df, lacking, shape = _vectors(spark, sf_dir)
    df = df.select("vec_id", F.posexplode("embedding").alias("x", "e"))
    v = F.floor(F.col("e").cast("double") * 1000).cast("int").alias("v")
    return Volume(_filled(df.select("vec_id", "x", v), lacking), shape, "int32")


def embeddings_mask(spark: SparkSession, sf_dir: str, least: int) -> Volume:
    return embeddings_volume(spark, sf_dir).map((F.col("v") >= least).cast("int"), "int32")


def embeddings_labels(spark: SparkSession, sf_dir: str) -> Volume:
    """Each vector's label plus one, along its row; 0 where a slice lacks the vector."""
    df, lacking, shape = _vectors(spark, sf_dir)
    return Volume(_filled(df.select("vec_id", _positions(), (F.col("label") + 1).alias("v")), lacking), shape, "int32")


def lineitem_volume(spark: SparkSession, sf_dir: str) -> Volume:
    """Quantities summed over line number, supplier and part, the latter two modulo 64."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    z, y, x = (F.col("l_linenumber") - 1).alias("z"), F.pmod("l_suppkey", F.lit(64)).cast("int").alias("y"), F.pmod("l_partkey", F.lit(64)).cast("int").alias("x")
    cells = df.groupBy(z, y, x).agg(F.sum("l_quantity").cast("int").alias("v"))
    return Volume.from_cells(cells, LI_SHAPE, "int32")
