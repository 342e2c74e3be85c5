"""Exact deduplication: two passes over a Bloom filter of repeated hashes.

Pass one sets a bit of a counting Bloom filter for each position that two rows or more hash
to. Pass two probes it: a row with a position that nobody shares is unique for certain and
passes straight through; only the rest are shuffled, by SHA-256 of the normalised text, and
settled exactly. DataFrame functions only.

The filter has at most 2**26 bits (2**20 words, the only broadcast). Beyond about 4 million
rows it fills up and lets more rows through to the exact shuffle, which moves hashes and ids
and no texts, so the result never depends on it.

Defined results: null text counts as empty; empty texts equal one another; of equal texts the
row with the largest doc_id stays, null ids last; of rows that also share the doc_id one stays.
Very long texts are hashed whole. An empty table gives an empty result. Extra columns pass
through ``exact_dedup``; inner columns are named with a leading ``__``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_bits, join_unique, materialize, probe, words_of


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; the quick path is for texts without other characters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_digest(text: Column) -> Column:
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def _positions(sha: str, bits: int) -> tuple[Column, Column]:
    h = F.xxhash64(sha)
    return h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))


def repeated_filter(digests: DataFrame, n: int, sha: str = "__sha") -> tuple[DataFrame, int]:
    """Pass one: the words of the bits that at least two rows set."""
    bits = filter_bits(n, 16)
    positions = digests.select(F.explode(F.array(*_positions(sha, bits))).alias("__pos"))
    return materialize(words_of(positions.groupBy("__pos").count().filter("count > 1")), "repeated"), bits


def maybe_repeated(df: DataFrame, words: DataFrame, bits: int, sha: str = "__sha") -> DataFrame:
    """Pass two: boolean __repeated, never false for a row whose hash occurs twice."""
    one, two = _positions(sha, bits)
    df = probe(probe(df, words, one, "__r1"), words, two, "__r2")
    return df.withColumn("__repeated", F.col("__r1") & F.col("__r2")).drop("__r1", "__r2")


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(docs.select("doc_id", text_digest(F.col("text")).alias("__sha"), F.monotonically_increasing_id().alias("__rid")), "digests")
    n = digests.count()
    words, bits = repeated_filter(digests, n)
    flagged = maybe_repeated(digests, words, bits)
    single = flagged.filter(~F.col("__repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256")
    )
    rest = flagged.filter("__repeated").drop("__repeated")
    groups = rest.groupBy("__sha").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.coalesce(F.max_by("__rid", "doc_id"), F.max("__rid")).alias("__stays")
    )
    groups = materialize(groups, "groups")
    settled = join_unique(rest, groups, "__sha", "group_size", n).select("doc_id", "keep_id", "group_size", (F.col("__rid") == F.col("__stays")).alias("kept"), F.col("__sha").alias("text_sha256"))
    return single.unionByName(settled)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents without their exact copies, all columns kept. Unique texts are not shuffled;
    of the possibly repeated ones each task sends one row per text."""
    hashed = docs.withColumn("__sha", text_digest(F.col("text")))
    digests = materialize(hashed.select("__sha"), "digests")
    words, bits = repeated_filter(digests, digests.count())
    flagged = maybe_repeated(hashed, words, bits)
    single = flagged.filter(~F.col("__repeated")).select(*docs.columns)
    stays = (
        flagged.filter("__repeated")
        .groupBy("__sha")
        .agg(F.max_by(F.struct(*docs.columns), F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("__row"))
        .select("__row.*")
    )
    return single.unionByName(stays)
