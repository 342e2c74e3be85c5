"""Benchmark decontamination by SimHash over item-sized windows.

A benchmark item of L words is looked for in every window of L words of a document. Windows and
items carry a 64-bit SimHash of their k-word shingles, each weighted by how often it occurs. The
fingerprints are matched by multi-index Hamming blocks: eight blocks of eight bits, of which one
has at most two differing bits when two fingerprints are within radius 23, so probing every value
within two bits of each block misses none. Candidates are verified by exact weighted Jaccard
similarity of the two shingle bags.

Similarity 0.8 needs eight ninths of a window's shingles to be an item's, so only windows with that
many shingles of any item are fingerprinted; the bound is exact. Of two items with similarity 0.8 the
fingerprints differ in about 10 of 64 bits (three standard deviations: 18), so radius 23 is wide.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
The benchmark is a set of queries. What a block of items takes on an executor, its index included,
is counted before it is sent there and bounded by ``MAX_BLOCK_BYTES``; larger benchmarks are taken
in blocks of items, one pass each.

Defined results: null or empty texts match nothing, null or word-less items are ignored; an item
with fewer than k words is one shingle; a text shorter than the item is one window; repeated
rows each give their result; a very long text is matched whole, its windows in one pass; empty
tables give empty results; extra columns, whatever their names, are ignored by ``contaminated`` and
pass through ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textkit import ALNUM, Words, array_pieces, buffers, mix, pieces, sequence_hash, shingle_hashes

RADIUS, BLOCKS = 23, 8
#: Bytes of one block of items on an executor, and what an item takes there besides its shingles:
#: its row of the Hamming block index. A character of text takes at most five bytes of shingles.
MAX_BLOCK_BYTES = 64 << 20
ITEM_BYTES, CHAR_BYTES = 4096, 5


def _near(bits: int) -> list[np.ndarray]:
    """For each byte value, the values within ``bits`` differing bits."""
    pop = np.array([bin(x).count("1") for x in range(256)])
    return [np.flatnonzero(pop[np.arange(256) ^ v] <= bits) for v in range(256)]


def fingerprints(shingles: np.ndarray, start: np.ndarray, count: int) -> np.ndarray:
    """SimHash of shingles[s:s + count] for each s: running sums of the bit votes."""
    votes = np.zeros((len(shingles) + 1, 64), np.int32)
    bits = np.unpackbits(shingles[:, None].view(np.uint8), axis=1, bitorder="little")
    np.cumsum(bits.astype(np.int32) * 2 - 1, axis=0, out=votes[1:])
    sums = votes[start + count] - votes[start]
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


class Items:
    """The benchmark: shingle bags, fingerprints and the Hamming block index."""

    def __init__(self, rows: list[tuple[int, str]], k: int, percent: int):
        self.k, self.percent = k, percent
        self.ids, self.words, self.bags, prints = [], [], [], []
        for item_id, text in rows:
            words = Words(*buffers(pa.array([text])), ALNUM).hash
            if len(words):
                s = shingle_hashes(words, k) if len(words) >= k else np.array([sequence_hash(words)], np.uint64)
                self.ids.append(item_id)
                self.words.append(len(words))
                self.bags.append(np.unique(s, return_counts=True))
                prints.append(fingerprints(s, np.zeros(1, np.int64), len(s))[0])
        self.prints = np.array(prints, np.uint64)
        self.lengths = np.array(self.words, np.int64)
        self.known = np.unique(np.concatenate([b[0] for b in self.bags])) if self.bags else np.zeros(0, np.uint64)
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.known >> np.uint64(44)).astype(np.int64)] = True
        near = _near(RADIUS // BLOCKS)
        self.index = np.zeros((BLOCKS, 256, len(self.ids)), bool)
        for i, p in enumerate(self.prints.tolist()):
            for b in range(BLOCKS):
                self.index[b, near[p >> 8 * b & 255], i] = True

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.gate[(shingles >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at
        found = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        return at[self.known[found] == shingles[at]]

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        values, counts = np.unique(shingles, return_counts=True)
        v, c = self.bags[item]
        _, x, y = np.intersect1d(values, v, assume_unique=True, return_indices=True)
        both = int(np.minimum(counts[x], c[y]).sum())
        return both / (int(counts.sum()) + int(c.sum()) - both)

    def matches(self, words: np.ndarray, runs: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of each item's best window of one text; ``runs``
        are the k-word shingles of the text's own words."""
        n, best = len(words), {}
        known = np.zeros(len(runs) + 1, np.int64)
        known[self.hits(runs) + 1] = 1
        known = np.cumsum(known)
        for length in np.unique(self.lengths).tolist():
            size = min(length, n)
            of = np.flatnonzero(self.lengths == length)
            if size < self.k or length < self.k:
                if length < self.k:
                    s = np.array([sequence_hash(words[i : i + length]) for i in range(n - length + 1)], np.uint64)
                    at = self.hits(s)
                    prints = s[at]
                    count, source = 1, s
                else:
                    continue
            else:
                count, source = size - self.k + 1, runs
                # similarity p needs an overlap of p / (1 + p) of both sizes together
                least = self.percent * (count + length - self.k + 1) / (100 + self.percent) - 1e-9
                at = np.flatnonzero(known[count:] - known[: len(runs) - count + 1] >= least)
                if not len(at):
                    continue
                low, high = int(at[0]), int(at[-1]) + count
                prints = fingerprints(source[low:high], at - low, count)
            blocks = prints[:, None].view(np.uint8)
            near = reduce(np.logical_or, (self.index[b][blocks[:, b]][:, of] for b in range(BLOCKS)))
            w, j = np.nonzero(near)
            close = np.bitwise_count(prints[w] ^ self.prints[of[j]]) <= RADIUS
            for at_w, item in zip(at[w[close]].tolist(), of[j[close]].tolist(), strict=True):
                sim = self.similarity(item, source[at_w : at_w + count])
                if sim * 100 >= self.percent - 1e-9 and sim > best.get(item, (0.0,))[0]:
                    best[item] = (sim, at_w, size)
        return [(i, *b) for i, b in sorted(best.items())]


def _texts(texts: pa.Array, items: Items) -> Iterator[tuple[int, list]]:
    """(row, matches) for the rows that have any."""
    words = Words(*buffers(texts), ALNUM)
    runs = shingle_hashes(words.hash, items.k)
    near = items.hits(runs)
    short = bool((items.lengths < items.k).any())
    rows = range(len(texts)) if short else np.unique(np.searchsorted(words.first, near, "right") - 1).tolist()
    for i in rows:
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b > a and (found := items.matches(words.hash[a:b], runs[a : max(a, b - items.k + 1)])):
            yield i, found


def _blocks(benchmark: DataFrame, k: int, percent: int) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, ordered by item_id."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += ITEM_BYTES + CHAR_BYTES * len(r["text"])
        if size > MAX_BLOCK_BYTES:
            yield Items(block, k, percent)
            block, size = [], 0
    if block:
        yield Items(block, k, percent)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per (document, item) found: doc_id, item_id, similarity, first_word, n_words of
    the best window."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, k, percent):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for piece in pieces(batch, "text"):
                    ids = piece.column("doc_id")
                    rows = [(ids[i].as_py(), items.ids[m[0]], *m[1:]) for i, found in _texts(piece.column("text"), items) for m in found]
                    if rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def _clean(texts: Column, shared: Broadcast[Items]) -> Column:
    """Does a text hold none of the items?"""

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for piece in array_pieces(batch):
                keep.append(np.ones(len(piece), bool))
                keep[-1][[i for i, _ in _texts(piece, shared.value)]] = False
            yield pa.array(np.concatenate(keep))

    return clean(texts.cast("string"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents in which no item is found, all columns kept. Only texts go to Python and only
    flags come back; no shuffle."""
    small_batches(docs.sparkSession)
    for items in _blocks(benchmark, k, percent):
        docs = docs.filter(_clean(F.col("text"), docs.sparkSession.sparkContext.broadcast(items)))
    return docs
