"""Language ID by compression with per-language dictionaries.

For each language a zstandard raw-content dictionary is cut from a bounded sample of its texts.
A text is encoded in blocks with every dictionary, and the language whose total is smallest wins.
``score`` is a soft minimum of the sizes; the call is rejected (``confident`` false) when the
second best is within ``margin`` of the best.

Texts are lower-cased, everything ASCII that is no letter becomes a space, and whole texts are
encoded, in blocks of ``BLOCK`` bytes so that a long text does not drown the dictionary in its
own repetitions.

Every non-null lang of the learning fold is learned, however rare. Fitting reads at most
``max_docs`` documents a language (smallest id hashes) and keeps at most ``DICTIONARY`` bytes of
them, an even share of each from a hash-chosen place of its text; texts of the fold crc32(doc_id)
mod 5 = 0 and null lang are left out.

Defined results: null text or one without a letter is ``und`` with score 0; equal sizes go to the
smaller language name; without any learned language everything is ``und``; repeated rows get
equal results; a null doc_id counts as the text "" for the fold; an empty table gives an empty
result; very long texts are encoded whole, block by block; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .quality import fold
from .textkit import pieces

MAX_DOCS, DICTIONARY, BLOCK, LEVEL, SHARPNESS, MARGIN = 256, 32 << 10, 2048, 5, 60.0, 0.01
ENCODERS = 256
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """A character of the Unicode categories L*: signs such as a superscript two are none."""
    return any(map(str.isalpha, text))


def normalise(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())


def dictionaries(docs: DataFrame, max_docs: int = MAX_DOCS) -> dict[str, bytes]:
    """Raw dictionary content for each language, from the learning fold."""
    docs = docs.select("lang", "doc_id", F.col("text").cast("string").alias("text"))
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    rate = learn.groupBy("lang").count().select("lang", F.least(F.lit(1.0), F.lit(2.0 * max_docs) / F.col("count")).alias("rate"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = learn.join(F.broadcast(rate), "lang").filter(chance < F.col("rate")).select("lang", "doc_id", "text")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = picked.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= max_docs)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    # a hash-chosen stretch of the text, long enough for the share after normalising; the hash also places the share in it
    long = F.floor(4 * DICTIONARY / F.col("n")).cast("int") + 1024
    places = F.greatest(F.lit(1), F.char_length("text") - long + 1)
    at = F.pmod(F.xxhash64(F.lit("stretch"), "doc_id"), places).cast("int") + 1
    place = F.pmod(F.xxhash64(F.lit("share"), "doc_id"), F.lit(1 << 30)).alias("place")
    chunks = rows.select("lang", F.struct("r", place, F.substring("text", at, long).alias("text")).alias("chunk")).groupBy("lang").agg(F.sort_array(F.collect_list("chunk")).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [(lang.as_py(), content([(c["place"], c["text"]) for c in chunks.as_py()])) for lang, chunks in zip(batch.column("lang"), batch.column("chunks"), strict=True)]
            yield pa.record_batch([pa.array([x[i] for x in of], t) for i, t in enumerate((pa.string(), pa.binary()))], names=["lang", "content"])

    return {r["lang"]: bytes(r["content"]) for r in chunks.mapInArrow(run, "lang string, content binary").collect() if len(r["content"]) >= 8}


def content(chunks: list[tuple[int, str]]) -> bytes:
    """``DICTIONARY`` bytes at most, dealt evenly: what short chunks leave goes to longer ones."""
    parts = [(place, p) for place, text in chunks if (p := normalise(text))]
    left, share = DICTIONARY - len(parts), {}
    for k, i in enumerate(sorted(range(len(parts)), key=lambda i: len(parts[i][1]))):
        share[i] = min(len(parts[i][1]), max(0, left) // (len(parts) - k))
        left -= share[i]
    out = []
    for i, (place, p) in enumerate(parts):
        start = place % (len(p) - share[i] + 1)
        out.append(p[start : start + share[i]])
    return b" ".join(out)


class Classifier:
    """Encoders are made for ``ENCODERS`` languages at a time, and kept if that is all of them."""

    def __init__(self, content: dict[str, bytes], margin: float = MARGIN):
        langs = sorted(content)
        self.margin, self.content = margin, content
        self.blocks = [langs[i : i + ENCODERS] for i in range(0, len(langs), ENCODERS)]
        self.kept = self._encoders(self.blocks[0]) if len(self.blocks) == 1 else None

    def _encoders(self, langs: list[str]) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(self.content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append((lang, zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False)))
        return out

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, False)] * len(texts)
        known = {i: normalise(t) for i, t in enumerate(texts) if t is not None and self.blocks and has_letter(t)}
        sizes: dict[int, list[tuple[int, str]]] = {i: [] for i in known}
        for langs in self.blocks:
            encoders = self.kept or self._encoders(langs)
            for i, data in known.items():
                blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
                sizes[i] += [(sum(len(c.compress(b)) for b in blocks), lang) for lang, c in encoders]
        for i, found in sizes.items():
            found.sort()
            best = max(found[0][0], 1)
            score = 1 / sum(math.exp(-SHARPNESS * (s / best - 1)) for s, _ in found)
            out[i] = found[0][1], score, len(found) == 1 or found[1][0] >= best * (1 + self.margin)
        return out


def identify_language(docs: DataFrame, max_docs: int = MAX_DOCS, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, confident."""
    small_batches(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(dictionaries(docs, max_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(content.value, margin)
        for batch in batches:
            for piece in pieces(batch, "text"):
                lang, score, sure = zip(*classifier.classify(piece.column("text").to_pylist()), strict=True)
                yield pa.record_batch([piece.column("doc_id"), piece.column("held_out"), pa.array(lang), pa.array(score), pa.array(sure)], names=["doc_id", "held_out", "lang_pred", "score", "confident"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, confident boolean")
