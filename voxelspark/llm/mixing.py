"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words. A document of a source with target / size = f is
taken floor(f) times for certain and once more with the fractional probability p = f - floor(f).
The probabilities are rounded in pairs: of two documents one gains and the other loses the same
mass (size * p), at random so that the expectation stays, until one of them is 0 or 1. So a
source's words stay on target through every step. Rows are folded, largest first, in buckets of about 64 and
each bucket's one undecided document goes up to the next level of a reduction tree, until one
document a source is left. The whole tree is DataFrame functions: collect_list of a bucket, then
``aggregate`` over it.

Defined results: null text has size 0; documents of size 0 take nothing; null is a source of its
own, ordered last; repeated doc_ids count as separate documents; an empty table gives an empty
result. Randomness is a hash of the ids and the seed, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
BUCKET = 64
#: Source tables up to this many rows are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000


def targets(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs) -> plus source_no, target. Water filling in closed form: in
    order of cap * size / weight, the capped sources are a prefix, found by running sums. One
    task holds one row for each source."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("__ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    df = sources.withColumn("source_no", F.row_number().over(named).cast("long"))
    df = df.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int")))
    df = df.withColumn("__ratio", F.col("source_size") * cap / F.col("__w"))
    df = df.withColumn("__full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap).withColumn("__gone", F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    df = df.withColumn("__level", (F.sum("source_size").over(everything) * share - F.col("__full")) / (F.sum("__w").over(everything) - F.col("__gone")))
    level = F.min_by(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level")), F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "source_no"))).over(everything)
    full = F.col("source_size") * cap
    df = df.withColumn("target", F.least(full, F.coalesce(level * F.col("__w"), full)).cast("double"))
    return df.select("source", "source_no", "source_size", "n_docs", "target")


def _uniform(seed: int, *cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / float(1 << 53)


_ITEM = "struct<size:bigint,id:bigint,p:double>"
_DONE = "array<struct<id:bigint,size:bigint,z:int>>"


def _fold(items: Column, seed: int) -> Column:
    """{open, done}: the bucket's one undecided item and the decided ones."""

    def item(of: Column, p: Column) -> Column:
        return F.struct(of["size"].alias("size"), of["id"].alias("id"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))

    def state(open_: Column, done: Column, who: Column, z: int) -> Column:
        one = F.struct(who["id"].alias("id"), who["size"].alias("size"), F.lit(z).cast("int").alias("z"))
        return F.struct(open_.alias("open"), F.concat(done, F.array(one)).alias("done"))

    def step(s: Column, x: Column) -> Column:
        o, done = s["open"], s["done"]
        a, p, b, q = o["size"].cast("double"), o["p"], x["size"].cast("double"), x["p"]
        mass = a * p + b * q
        up, down = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))
        rise = _uniform(seed, o["id"], o["size"], x["id"], x["size"]) * (up + down) < down
        raised = F.when(a * (1 - p) <= b * q, state(item(x, (mass - a) / b), done, o, 1)).otherwise(state(item(o, mass / a), done, x, 0))
        lowered = F.when(a * p <= b * (1 - q), state(item(x, mass / b), done, o, 0)).otherwise(state(item(o, (mass - b) / a), done, x, 1))
        first = F.struct(x.alias("open"), done.alias("done"))
        return F.when(o.isNull(), first).otherwise(F.when(rise, raised).otherwise(lowered))

    start = F.struct(F.lit(None).cast(_ITEM).alias("open"), F.array().cast(_DONE).alias("done"))
    return F.aggregate(items, start, step)


def dependent_round(items: DataFrame, largest: int, seed: int = 17) -> DataFrame:
    """(source_no, bucket_count, id, size > 0, 0 < p < 1) -> (source_no, id, size, z in {0, 1}).
    ``largest``: the most items of one source, which fixes the depth of the tree."""
    spread = F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.col("bucket_count"))
    level = items.select("source_no", spread.alias("bucket"), F.struct("size", "id", "p").alias("item"))
    buckets, decided, k = max(1, math.ceil(largest / BUCKET)), [], 0
    while True:
        folded = level.groupBy("source_no", "bucket").agg(F.sort_array(F.collect_list("item"), asc=False).alias("__items")).select("source_no", "bucket", _fold(F.col("__items"), seed + k).alias("__s"))
        folded = materialize(folded.select("source_no", "bucket", "__s.open", "__s.done"), f"pivot{k}")
        decided.append(folded.select("source_no", F.explode("done").alias("d")).select("source_no", "d.*"))
        if buckets == 1:
            break
        buckets, k = math.ceil(buckets / BUCKET), k + 1
        level = folded.select("source_no", F.expr(f"bucket div {BUCKET}").alias("bucket"), F.col("open").alias("item"))
    last = folded.select("source_no", "open.id", "open.size", (_uniform(seed - 1, F.col("open.id"), F.col("source_no")) < F.col("open.p")).cast("int").alias("z"))
    for d in decided:
        last = last.unionByName(d)
    return last


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    sources = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, share, cap), "sources")
    n_sources, largest = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    side = F.broadcast(sources) if n_sources <= MAX_BROADCAST_SOURCES else sources
    share_of = F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0))
    rows = sized.join(side.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", "size", "source_no", "source_size", "target", "n_docs", F.floor(share_of).alias("base"), (share_of - F.floor(share_of)).alias("p")
    )
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    settled = rows.filter(~open_).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("base")).alias("taken"))
    items = rows.filter(open_).select("source_no", F.col("doc_id").alias("id"), "size", "p", F.ceil(F.col("n_docs") / BUCKET).alias("bucket_count"))
    rounded = dependent_round(items, int(largest), seed)
    numbered = sources.select("source_no", "source_size", "target", F.floor(share_of).alias("base"))
    numbered = F.broadcast(numbered) if n_sources <= MAX_BROADCAST_SOURCES else numbered
    taken = rounded.join(numbered, "source_no").select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * (F.col("base") + F.col("z"))).alias("taken"))
    return settled.unionByName(taken)
