"""N-gram Jaccard join: documents linked when their shingle sets are similar enough.

The overlap counts are a product of the sparse document x n-gram incidence matrix with its
transpose, done in blocks (one per n-gram) on as few entries as exactness allows:

1. Documents with equal shingle sets are one class (equal sets have similarity 1).
2. A total order of n-grams puts the frequent ones last. Two sets within the threshold must
   share an n-gram among the first n - ceil(t n) + 1 of each, so only those entries are
   multiplied. Blocks with one class are dropped.
3. Each block first meets its hub, the class that shares the most entries overall, and every
   class keeps its best hub by accumulated overlap. Links found are contracted to components.
   Then what still lies in different components of one block is compared in full; a block
   inside one component costs nothing, so a group of near copies is never expanded into pairs.
   Blocks of the same classes, as the n-grams of a shared passage make, are met once, with the
   number of their n-grams as weight (told apart by size and 128 bits of their classes' hashes).
   A heavy block is cut into a grid of cells, each a join key of its own, so that no key holds
   more than about MAX_CELL comparisons; every pair still meets in exactly one cell.
4. A pair is discarded when its sizes, or the parity sketches of the two sets (a lower bound of
   their symmetric difference), rule the threshold out: a small sketch travels with the entries
   (for sets of more than 2048 n-grams one of 4096 bits beside it)
   and acts inside the join, one as large as the set follows. What is left is counted on the
   whole sets.

Every linked pair ends in one component; the number of partners or candidates has no cap. The
list of frequent n-grams steers only the order, has at most 2**17 entries, and its size is the
bound of what is broadcast. Hashes have 64 bits.

Defined results: null or word-less text is an empty set and linked with nothing; a text with
fewer than k words is one shingle; documents with one doc_id are one node; a row with a null
doc_id has the component of a row with an equal set, else null, and adds no link; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import anti_join_few, bloom_semi, discard, join_unique, materialize, small_batches
from .components import connected_components
from .textkit import pieces, shingles_by_text

MAX_FREQUENT = 1 << 17
FREQUENT_DF = 16
_BUFFER = 1 << 21
#: Comparisons of a block, or of a cell of its grid, that one join key may hold.
MAX_CELL = 1 << 24
#: Bits of a sketch: twice the set's size, within these bounds.
_SKETCH_BITS = 1 << 10, 1 << 18
#: Words of the small sketch that travels with the entries: sixteen of 64 bits.
_SMALL = [f"k{i}" for i in range(16)]
#: A set of more n-grams than this fills a small sketch, so one of _LONG_WORDS words travels too.
_LONG, _LONG_WORDS = 2048, 64


def _class_id(shingles: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _statistics(k: int):
    """doc rows (doc_id, cid, n) and, with n = -1, n-grams repeated within a buffer of about
    two million: (count, n-gram, -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def repeated() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts > 1
            held.clear()
            seen.clear()
            return pa.record_batch({"doc_id": pa.array(counts[many].astype(np.int64)), "cid": pa.array(values[many].view(np.int64)), "n": pa.array(np.full(many.sum(), -1, np.int32))})

        total = 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                cids, sizes = [], []
                for s in shingles_by_text(piece.column("text"), k):
                    cids.append(_class_id(s) if len(s) else None)
                    sizes.append(len(s))
                    if len(s) and cids[-1] not in seen:
                        seen.add(cids[-1])
                        held.append(s)
                        total += len(s)
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "cid": pa.array(cids, pa.int64()), "n": pa.array(sizes, pa.int32())})
                if total > _BUFFER:
                    yield repeated()
                    total = 0
        if held:
            yield repeated()

    return run


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the set's hashes by their low bits; halves fold onto each other by xor."""
    bits, most = _SKETCH_BITS
    while bits < 2 * len(s) and bits < most:
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _parities(s: np.ndarray, words: int) -> list[int]:
    odd = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _small_sketch(s: np.ndarray) -> list[int]:
    return _parities(s, len(_SMALL)) + (_parities(s, _LONG_WORDS) if len(s) > _LONG else [])


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their sketches."""
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def _possible(percent: int):
    """The pairs whose sketches leave the threshold within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                keep.append(_linked((na + nb - differing(sa, sb)) // 2, na, nb, percent))
            yield batch.select(["a", "b", "na", "nb", "da", "db"]).filter(pa.array(keep, pa.bool_()))

    return run


def _prefixes(k: int, percent: int, frequent: np.ndarray, rank: np.ndarray):
    """(cid, doc_id, n, sketch, k, prefix) of each class that the task has not met yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc_id, s in zip(piece.column("doc_id").to_pylist(), shingles_by_text(piece.column("text"), k), strict=True):
                    n = len(s)
                    if not n or (cid := _class_id(s)) in seen:
                        continue
                    if len(seen) < 1 << 18:
                        seen.add(cid)
                    p = n - (percent * n + 99) // 100 + 1
                    prefix = s[:p]
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        common = frequent[at] == s
                        if common[:p].any():
                            rare = s[~common]
                            prefix = rare[:p]
                            if len(prefix) < p:
                                last = s[common]
                                prefix = np.concatenate((prefix, last[np.argsort(rank[at[common]], kind="stable")][: p - len(prefix)]))
                    for column, value in zip(out, (cid, doc_id, n, _sketch(s), _small_sketch(s), prefix.view(np.int64)), strict=True):
                        column.append(value)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.list_(pa.int64()))], names=["cid", "doc_id", "n", "sketch", "k", "prefix"])

    return run


def _whole_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = [(_class_id(s), s.view(np.int64)) for s in shingles_by_text(piece.column("text"), k) if len(s)]
                yield pa.record_batch([pa.array([c for c, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.list_(pa.int64()))], names=["cid", "shingles"])

    return run


def _linked(overlap, na, nb, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.k, self.percent = k, percent
        small_batches(docs.sparkSession)
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        stats = materialize(self.texts.mapInArrow(_statistics(k), "doc_id long, cid long, n int"), "ngram_stats")
        self.nodes = stats.filter("n >= 0")
        top = stats.filter("n < 0").groupBy("cid").agg(F.sum("doc_id").alias("df")).filter(F.col("df") >= FREQUENT_DF).orderBy(F.desc("df"), "cid").limit(MAX_FREQUENT).collect()
        values, counts = np.array([r["cid"] for r in top], np.int64).view(np.uint64), np.array([r["df"] for r in top], np.int64)
        order = np.argsort(values)
        rows = materialize(self.texts.filter("doc_id is not null").mapInArrow(_prefixes(k, percent, values[order], counts[order]), "cid long, doc_id long, n int, sketch binary, k array<long>, prefix array<long>"), "ngram_prefix")
        self.rows = rows
        self.meta = materialize(rows.groupBy("cid").agg(F.min(F.struct("doc_id", "n", "sketch", "k")).alias("m")).select("cid", "m.*"), "ngram_meta")

    def blocks(self) -> DataFrame | None:
        """(tok, cid, c): the entries of n-grams that two classes or more share; c: the block's size."""
        entries = self.rows.select("cid", F.explode("prefix").alias("tok"))
        shared = entries.groupBy("tok").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo <> hi").select("tok", "c")
        shared = materialize(shared, "ngram_shared")
        n_shared = shared.count()
        if not n_shared:
            return None
        entries = bloom_semi(entries, "tok", shared.select("tok"), n_shared)
        total = max(1, shared.agg(F.sum("c")).first()[0] or 0)
        blocks = materialize(join_unique(entries, shared, "tok", "c", total).distinct(), "ngram_blocks")
        discard(shared)
        return blocks

    def verified(self, pairs: DataFrame) -> DataFrame | None:
        """Links among the distinct pairs (a, b), None if there are none."""
        meta = lambda s: self.meta.select(F.col("cid").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"), F.col("doc_id").alias(f"d{s}"))
        kept = pairs.join(meta("a"), "a").filter("na > 0").join(meta("b"), "b").filter(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        kept = kept.select("a", "b", "na", "nb", "da", "db", "sa", "sb").mapInArrow(_possible(self.percent), "a long, b long, na int, nb int, da long, db long")
        kept = materialize(kept, "ngram_pairs")
        if not kept.count():
            return None
        ids = materialize(kept.select(F.explode(F.array("da", "db")).alias("doc_id")).distinct(), "ngram_ids")
        # a document that the Bloom filter passes by mistake only adds a set that no pair asks for
        some = bloom_semi(self.texts, "doc_id", ids, ids.count(), per_row=64)
        sets = materialize(some.mapInArrow(_whole_sets(self.k), "cid long, shingles array<long>"), "ngram_sets")
        # of each pair the class with fewer pairs moves its set; the other's, a hub, stays in place
        degree = kept.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").count()
        of = lambda s: degree.select(F.col("cid").alias(s), F.col("count").alias(f"c{s}"))
        hub, member = F.when(F.col("ca") >= F.col("cb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("ca") >= F.col("cb"), F.col("b")).otherwise(F.col("a"))
        turned = kept.join(of("a"), "a").join(of("b"), "b").select(hub.alias("h"), member.alias("m"), "na", "nb")
        side = lambda s: sets.select(F.col("cid").alias(s), F.col("shingles").alias(f"t{s}"))
        both = turned.join(side("m"), "m").join(side("h"), "h").withColumn("overlap", F.size(F.array_intersect("tm", "th")))
        links = materialize(both.filter(_linked(F.col("overlap"), F.col("na"), F.col("nb"), self.percent)).select(F.col("h").alias("a"), F.col("m").alias("b")), "ngram_links")
        discard(kept, ids, sets)
        return links

    def _possible_pair(self, x: str, y: str) -> Column:
        """Do the sizes and the small sketches of two entries leave the threshold within reach?"""
        nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
        differ = sum((F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in _SMALL), F.lit(0))
        small = (100 * F.least(nx, ny) >= self.percent * F.greatest(nx, ny)) & _linked(F.floor((nx + ny - differ) / 2), nx, ny, self.percent)
        differ = F.aggregate(F.zip_with(f"{x}long", f"{y}long", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, one: total + one)
        both = F.col(f"{x}long").isNotNull() & F.col(f"{y}long").isNotNull()
        return small & F.when(both, _linked(F.floor((nx + ny - differ) / 2), nx, ny, self.percent)).otherwise(True)

    def labels(self) -> DataFrame:
        """(cid, label) of the classes that have a link."""
        blocks = self.blocks()
        empty = self.nodes.sparkSession.createDataFrame([], "cid long, label long")
        if blocks is None:
            return empty
        weight = blocks.groupBy("cid").agg(F.sum("c").alias("w"))
        entries = materialize(blocks.join(weight, "cid"), "ngram_entries")
        discard(blocks)
        links, labels = None, None
        for turn in range(2):
            at = entries.withColumn("label", F.col("cid")) if labels is None else entries.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
            marks = [F.xxhash64("cid").alias("p"), F.xxhash64("cid", F.lit(1)).alias("q")]
            size = at.select("tok", "label", "w", "cid", *marks).groupBy("tok", "label").agg(F.count(F.lit(1)).alias("here"), F.max(F.struct("w", "cid")).alias("best"), F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q"))
            # of a mixed block: its largest component, its hub and its size
            block = size.groupBy("tok").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("here", "label")).alias("main"), F.max("best").alias("hub"), F.sum("here").alias("c"), F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q")).filter("labels > 1")
            # blocks of the same classes are one, met once; times: how many n-grams it stands for
            block = block.groupBy("c", "p", "q").agg(F.min_by(F.struct("tok", "main", "hub"), "tok").alias("one"), F.count(F.lit(1)).alias("times")).select("one.*", "c", "times")
            side = F.greatest(F.lit(1), F.ceil(F.sqrt((F.col("c") - F.col("main.here")) * F.col("c") / MAX_CELL))).cast("int")
            block = materialize(block.select("tok", F.col("main.label").alias("main"), F.col("hub.cid").alias("hub"), "c", "times", side.alias("side")), "ngram_mixed")
            total = block.agg(F.sum("c")).first()[0]
            if not total:
                break
            mixed = materialize(join_unique(at.select("tok", "cid", "label"), block, "tok", "c", total), "ngram_left")
            if turn == 0:
                votes = mixed.filter("cid <> hub").groupBy("cid", "hub").agg(F.sum("times").alias("votes"))
                pairs = votes.groupBy("cid").agg(F.max_by("hub", F.struct("votes", "hub")).alias("hub")).select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
            else:
                # sizes and small sketches settle most pairs inside the join itself
                long = F.when(F.size("k") > len(_SMALL), F.slice("k", len(_SMALL) + 1, _LONG_WORDS)).alias("long")
                wide = mixed.join(self.meta.select("cid", "n", long, *(F.col("k")[i].alias(k) for i, k in enumerate(_SMALL))), "cid")
                # row of the grid by x, column by y: x goes to all columns of its row, y to all rows
                own, every = F.pmod(F.xxhash64("cid"), "side").cast("int"), F.explode(F.sequence(F.lit(0), F.col("side") - 1))
                few = wide.filter("label <> main").select("tok", own.alias("row"), every.alias("column"), F.col("cid").alias("x"), F.col("label").alias("lx"), *(F.col(c).alias(f"x{c}") for c in ("n", "long", *_SMALL)))
                full = wide.select(F.col("tok").alias("tok_y"), every.alias("row_y"), own.alias("column_y"), F.col("cid").alias("y"), F.col("label").alias("ly"), (F.col("label") == F.col("main")).alias("m"), *(F.col(c).alias(f"y{c}") for c in ("n", "long", *_SMALL)))
                cell = (F.col("tok") == F.col("tok_y")) & (F.col("row") == F.col("row_y")) & (F.col("column") == F.col("column_y"))
                met = few.join(full, cell & (F.col("lx") != F.col("ly")) & (F.col("m") | (F.col("x") < F.col("y"))) & self._possible_pair("x", "y"))
                pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            found = self.verified(pairs)
            discard(block, mixed)
            if found is not None:
                links = found if links is None else links.unionByName(found)
                labels = connected_components(links)
        return empty if labels is None else labels


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links), class_id (of equal shingle sets, null when empty)."""
    join = _Join(docs, k, percent)
    labels = join.labels()
    nodes = join.nodes
    sizes = nodes.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    sizes = sizes.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = sizes.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    total = nodes.count()
    classes = materialize(join_unique(sizes, materialize(smallest, "ngram_smallest"), "label", "classes", total).select("cid", "copies", "component_id"), "ngram_classes")
    full = join_unique(nodes.filter("n > 0"), classes, "cid", "copies", total)
    empty = nodes.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("cid").alias("class_id")).unionByName(empty)


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, of each component the one with the smallest doc_id."""
    gone = ngram_jaccard_join(docs, k, percent).filter("doc_id <> component_id")
    return anti_join_few(docs, "doc_id", gone.select("doc_id"))
