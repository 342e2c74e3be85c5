"""Shared plumbing of the training-data operators.

* Scratch tables: lineage is cut by writing a Parquet table below the folder
  named in ``spark.checkpoint.dir``, which every executor can read, so a lost
  executor costs a re-read and never a recomputation of the whole corpus.
* A size-bounded Bloom filter held as a table of 64-bit words.
* A join that deals the few hot keys to several parts.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest Bloom filter: 2**26 bits are at most 2**20 words of (long, long).
MAX_FILTER_BITS = 1 << 26
#: A key is hot when it holds this share of all rows; so at most 1 / share keys are hot.
HOT_SHARE = 0.001

_SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own bounds of an Arrow batch and those for whole texts.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(4 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are bounded by bytes, as ten thousand long texts are too many.
    Plans read the bounds when they run, so they stay in the session; bounds that the caller has
    chosen are left alone."""
    for key, (default, small) in _BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, small)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir of the session. Only a local session, whose one
    process sees its own disk, gets a folder of ours where none is set; a cluster's executors
    could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "voxelspark-checkpoints")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/voxelspark/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


@contextlib.contextmanager
def _shuffles_end_with_the_query(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run in here go when it ends; the setting is put back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table. The table ends the
    lineage, so the write's shuffle files go with it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_end_with_the_query(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _SCRATCH:
        _SCRATCH.remove(path)


def cleanup(spark: SparkSession) -> None:
    """Delete the scratch tables this process wrote; call it once results are stored."""
    while _SCRATCH:
        _delete(spark, _SCRATCH[-1])


def filter_bits(n: int, per_row: int = 16) -> int:
    """Bits for n rows: a power of two of at least per_row * n, within the bound."""
    return min(MAX_FILTER_BITS, 1 << max(16, (max(n, 1) * per_row - 1).bit_length()))


def words_of(positions: DataFrame, pos: str = "__pos") -> DataFrame:
    """(word, bits) table of the bit positions in column ``pos``."""
    return positions.groupBy(F.shiftright(pos, 6).alias("__word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({pos} & 63 AS int))")).alias("__bits")
    )


def probe(df: DataFrame, words: DataFrame, position: Column, out: str) -> DataFrame:
    """Add boolean ``out``: is the bit at ``position`` set? ``words`` has at most 2**20 rows."""
    p = f"{out}_p"
    hit = words.select(F.col("__word").alias(f"{out}_w"), F.col("__bits").alias(f"{out}_b"))
    return (
        df.withColumn(p, position)
        .join(F.broadcast(hit), F.shiftright(F.col(p), 6) == F.col(f"{out}_w"), "left")
        .withColumn(out, F.coalesce(F.expr(f"(shiftrightunsigned({out}_b, cast({p} & 63 AS int)) & 1) = 1"), F.lit(False)))
        .drop(p, f"{out}_w", f"{out}_b")
    )


def bloom_semi(df: DataFrame, key: str, keys: DataFrame, n_keys: int, per_row: int = 16) -> DataFrame:
    """Rows of ``df`` whose key may be in ``keys`` (single column ``key``, n_keys rows): no
    false negatives. Above the bound the filter fills up and passes more rows, never fewer."""
    m = filter_bits(n_keys, per_row)
    position = lambda c: F.xxhash64(c).bitwiseAND(F.lit(m - 1))
    words = materialize(words_of(keys.select(position(F.col(key)).alias("__pos"))), "bloom")
    return probe(df, words, position(F.col(key)), "__maybe").filter("__maybe").drop("__maybe")


def anti_join_few(df: DataFrame, key: str, drop_ids: DataFrame) -> DataFrame:
    """``df`` without the rows whose key is in ``drop_ids``. Rows that a bounded Bloom filter
    clears pass straight through; only the possible hits are shuffled."""
    ids = materialize(drop_ids.select(F.col(key).alias("__id")).distinct(), "drop_ids")
    m = filter_bits(ids.count(), 16)
    position = lambda c: F.xxhash64(c).bitwiseAND(F.lit(m - 1))
    words = materialize(words_of(ids.select(position(F.col("__id")).alias("__pos"))), "bloom")
    flagged = probe(df, words, position(F.col(key)), "__maybe")
    clear = flagged.filter(~F.col("__maybe")).drop("__maybe")
    rest = flagged.filter("__maybe").drop("__maybe")
    return clear.unionByName(rest.join(ids, rest[key] == ids["__id"], "left_anti"))


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner", share: float = HOT_SHARE) -> DataFrame:
    """Join on ``key``, unique in ``right``, whose column ``weight`` counts the rows of ``left``
    with that key (``total`` in all). A key with more than ``share`` of all rows is dealt to
    parts of about that size: its rows by a hash of themselves and of their partition, its one
    row of ``right`` to every part. There are at most 1 / share such keys, so their list is
    broadcast, and 1 / share more rows of ``right``. One join, whose shuffle reads ``left`` once."""
    least = max(1, int(total * share))
    parts = F.greatest(F.lit(1), F.ceil(F.col(weight) / least)).cast("int")
    hot = right.filter(F.col(weight) > least).select(key, parts.alias("__parts"))
    part = F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__part", part).drop("__parts")
    copies = right.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [key, "__part"], how).drop("__part")
