"""Quality classifier by non-negative positive-unlabelled learning.

Trusted positives are labelled rows with quality 1; unlabelled rows are documents of the
training fold with any label hidden. A small network over whole-text statistics minimises the
non-negative unbiased risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the logistic loss, so that its sigmoid estimates P(label 1 | text). When the second term is
negative its gradient is followed upwards instead (the usual correction).

The prior is that of the unlabelled rows, estimated by their scores (``estimated_prior``); it does
not lean on the share of the labels that is positive, which need not be that of the documents.

The fit uses a bounded sample: at most ``max_rows`` ids of each label and ``max_rows`` unlabelled
ids, the ones with the smallest hashes, and one row an id. Scoring is one pass without a shuffle: only texts
go to Python and only scores come back. doc_id, lang, source and labels are never features.

Defined results: null counts as empty, and an empty text gets the model's score for no words;
without any positive row every score is 0.5; null ids are scored, held_out is then false;
repeated rows get equal scores, whatever rows stand beside them; of sampled rows with one doc_id
the one with the least features is learned from; a text of any length is counted in pieces; an
empty table gives an empty result; extra columns, whatever their names, pass through ``keep_good``
and are ignored by ``quality_scores``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textkit import NON_SPACE, Words, array_pieces, buffers, mix, shingle_hashes

MAX_ROWS = 8192
THRESHOLD = 0.7
HELD_OUT = 2
#: Bytes counted at a time.
_COUNTED = 1 << 20


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256)
    t[[ord(c) for c in chars]] = 1
    return t


_ASCII = "".join(map(chr, range(33, 127)))
_CLASSES = np.stack([
    _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _table("abcdefghijklmnopqrstuvwxyz"),
    _table("0123456789"),
    _table("!?"),
    _table(".,;:'\"()-"),
    _table("".join(c for c in _ASCII if not c.isalnum() and c not in "!?.,;:'\"()-")),
    _table("\n\r"),
])
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in _ASCII if not c.isalnum() and c not in ".,;:'\"()-?"]] = True


def _byte_counts(data: np.ndarray) -> np.ndarray:
    """How often each byte occurs; a long text is counted in pieces."""
    return sum((np.bincount(data[at : at + _COUNTED], minlength=256) for at in range(0, len(data), _COUNTED)), np.zeros(256, np.int64))


def features(texts: pa.Array) -> np.ndarray:
    """One row of whole-text statistics for each text; no value depends on another text."""
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    words = Words(data, offsets, NON_SPACE)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    first = words.first
    count = np.diff(first)
    many = np.maximum(count, 1).astype(np.float64)
    c = len(_CLASSES)
    out = np.zeros((n, c + 8))

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[first[1:]] - total[first[:-1]]

    at = offsets.tolist()
    for i in range(n):
        out[i, :c] = _CLASSES @ _byte_counts(data[at[i] : at[i + 1]])
    out[:, :c] /= size[:, None]
    out[:, c] = np.log1p(count)
    out[:, c + 1] = per_text(words.end - words.start) / many / 10
    if len(words.hash):
        out[:, c + 2] = per_text(_PUNCT[data[words.end - 1]]) / many
        out[:, c + 3] = per_text(words.end - words.start == 1) / many
        same = np.concatenate(([False], words.hash[1:] == words.hash[:-1]))
        same[first[:-1][first[:-1] < len(same)]] = False
        out[:, c + 4] = per_text(same) / many
        for j, k in ((5, 1), (6, 4)):
            runs = words.hash if k == 1 else shingle_hashes(words.hash, k)
            start = np.arange(len(runs))
            owner = np.searchsorted(first, start, "right") - 1
            own = start + k <= first[owner + 1]  # all k words are of one text
            runs, owner = runs[own], owner[own]
            tagged = np.unique(mix(runs + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
            out[:, c + j] = np.bincount(owner[tagged], minlength=n)[:n] / many
        out[:, c + 5] *= np.log1p(many) / 6
    out[:, c + 7] = count == 0
    return out


class Model:
    """Standardised features, one hidden layer of tanh units, one logit."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 12, steps: int = 400, rate: float = 0.02):
        """Without a prior it parts positives from unlabelled rows, both of equal weight."""
        self.constant = None
        if not len(positive) or not len(unlabelled):
            self.constant = 0.5
            return
        self.mean = unlabelled.mean(0)
        self.scale = np.maximum(unlabelled.std(0), 1e-3)
        p, u = self._standard(positive), self._standard(unlabelled)
        x = np.concatenate((p, u))
        is_p = np.arange(len(x)) < len(p)
        rng = np.random.default_rng(7)
        self.w1 = rng.normal(0, 0.4, (x.shape[1], hidden))
        self.b1 = np.zeros(hidden)
        self.w2 = rng.normal(0, 0.4, hidden)
        self.b2 = np.zeros(1)
        weights = [self.w1, self.b1, self.w2, self.b2]
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for t in range(1, steps + 1):
            h = np.tanh(x @ self.w1 + self.b1)
            s = 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))
            minus = -np.log(np.maximum(1 - s, 1e-12))  # loss of calling x negative
            # d loss(+1) = s - 1, d loss(-1) = s
            if prior is None:
                g = np.where(is_p, (s - 1) / len(p), s / len(u)) / 2
            else:
                negative = minus[~is_p].mean() - prior * minus[is_p].mean()
                plus_grad = np.where(is_p, prior * (s - 1) / len(p), 0.0)
                minus_grad = np.where(is_p, -prior * s / len(p), s / len(u))
                g = plus_grad + minus_grad if negative >= 0 else -minus_grad
            back = np.outer(g, self.w2) * (1 - h * h)
            grads = [x.T @ back + 1e-4 * self.w1, back.sum(0), h.T @ g + 1e-4 * self.w2, np.array([g.sum()])]
            for w, dw, a, b in zip(weights, grads, m, v, strict=True):
                a *= 0.9
                a += 0.1 * dw
                b *= 0.999
                b += 0.001 * dw * dw
                w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(np.tanh(self._standard(x) @ self.w1 + self.b1) @ self.w2 + self.b2, -30, 30)))


def estimated_prior(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows of x. A network fitted on one half of the
    rows scores the other half; the estimates of both halves are averaged. With labelled negatives
    it parts the two classes, and the unlabelled rows' mean score lies between the classes' means
    as the prior does between 0 and 1. Without any it parts positives from unlabelled rows, and
    the prior is the smallest ratio of unlabelled to positive rows above a score, taken where the
    ratio's confidence bound is least (best bin estimation). The share of positives among the
    labelled rows plays no part."""
    half, found = np.arange(len(x)) % 2 == 0, []
    for learn in (half, ~half):
        p, u = x[positive & ~learn], x[unlabelled & ~learn]
        if (negative & learn).any() and (negative & ~learn).any() and (positive & learn).any() and len(p) and len(u):
            model = Model(x[positive & learn], x[negative & learn], None)
            low, high = model.score(x[negative & ~learn]).mean(), model.score(p).mean()
            if high - low > 0.1:
                found.append((model.score(u).mean() - low) / (high - low))
        elif len(p) and len(u):
            model = Model(x[positive & learn], x[unlabelled & learn], None)
            p, u = np.sort(model.score(p)), np.sort(model.score(u))
            share_p = 1 - np.arange(len(p)) / len(p)  # positives that reach p[i]
            share_u = 1 - np.searchsorted(u, p, "left") / len(u)
            slack = np.sqrt(np.log(40) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)  # nine in ten
            best = np.argmin((share_u + slack) / share_p)
            found.append(share_u[best] / share_p[best])
    if not found:
        return 0.5
    prior = float(np.clip(np.mean(found), 0.01, 0.99))
    # too high a prior calls negatives positive, too low a one costs little: one standard error less
    return max(0.01, prior - (prior * (1 - prior) / unlabelled.sum()) ** 0.5)


def fold(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def _text_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for piece in array_pieces(texts):
            yield pa.array(list(features(piece)), pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on a bounded sample of the rows outside the held-out fold: at most 3 * max_rows ids,
    one row each, whose features alone come to the driver."""
    small_batches(docs.sparkSession)
    order = F.xxhash64("doc_id")
    learn = fold(F.col("doc_id"), 4) != HELD_OUT
    first = lambda rows, name: rows.filter(F.col("doc_id").isNotNull() & learn).select("doc_id").distinct().orderBy(order, "doc_id").limit(max_rows).withColumn(name, F.lit(True))
    wanted = first(labels.filter("quality = 1"), "p").join(first(labels.filter("quality = 0"), "n"), "doc_id", "full").join(first(docs, "u"), "doc_id", "full")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.concat_arrays([pa.array([], pa.list_(pa.float64())), *_text_features(iter([batch.column(4)]))])
            yield pa.record_batch([*batch.columns[:4], x], names=["doc_id", *"pnu", "x"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *"pnu", "text").mapInArrow(run, "doc_id long, p boolean, n boolean, u boolean, x array<double>")
    got = found.groupBy("doc_id", *"pnu").agg(F.min("x").alias("x")).toArrow()
    if not got.num_rows:
        return Model(np.zeros((0, 1)), np.zeros((0, 1)), 0.5)
    got = got.sort_by("doc_id")
    x = np.array(got["x"].to_pylist())
    p, n, u = (np.array(got[c].fill_null(False).to_pylist()) for c in "pnu")
    return Model(x[p], x[u], estimated_prior(x, p, n, u))


def scorer(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Column:
    """The score of column ``text``: texts go to Python and scores come back."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(model.value.score(features(p)) for p in array_pieces(texts))]))

    return score(F.col("text").cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    held = F.coalesce(fold(F.col("doc_id"), 4) == HELD_OUT, F.lit(False)) & F.col("doc_id").isNotNull()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), scorer(docs, labels, max_rows).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that the classifier accepts, all columns kept; rows stay in the JVM."""
    return docs.filter(scorer(docs, labels, max_rows) >= THRESHOLD)
