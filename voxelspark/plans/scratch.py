"""Lineage cuts in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session gets a folder of our own where it
    is unset: a cluster's executors do not see each other's disks."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or "file://" + os.path.join(tempfile.gettempdir(), "voxelspark-checkpoints")).rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write the rows once and return the written table and its path."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/voxelspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
