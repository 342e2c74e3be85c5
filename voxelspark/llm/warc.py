"""Deterministic sharded WARC writer and its reader.

Records are dealt to shards by ranges of (page_id, hash of the payload). The ranges hold about equal
bytes: their borders are quantiles of the rows whose hash falls into a sample, ``SAMPLES`` a shard,
so they depend on the data alone and not on the number of tasks, and neither an outlying id, nor a
cluster of ids, nor many rows without an id make a shard larger. Only rows with equal id and equal
payload stay together. A task takes one shard, which is sorted by page_id and written as one or
more files, rolled by compressed size. Every record is a gzip member with regenerated headers and
digests and a fixed date, so writing twice gives the same bytes.

A file is written under a temporary name and renamed when it is complete; the table of files
(name, records, bytes, SHA-256) is written last, by Spark's committer, and readers open the files
it names. A task that is run again replaces its files by equal ones.

Of records with equal payloads of ``least`` bytes or more, the one with the largest page_id is a
response and the others revisit it. The ids that revisit are found on digests, and travel to the
shard as small rows sorted before their page: the pages themselves are shuffled once, to their
shard, and no join moves them.

Defined results: null html is an empty payload, a null url becomes urn:page:<id>; a null page_id
is written without an id and read back as null, and the first of equal payloads without any id is
the response; of rows with equal page_id and payload the first
is the response; a very long payload is held by its task alone; empty tables give no file; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, materialize, scratch_path, small_batches

LEAST = 1000
SAMPLES = 64
SHARD_BYTES = 256 << 20
ROLL_BYTES = 128 << 20
DATE = "2000-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    text = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _member(headers: list[tuple[str, str]], block: bytes, level: int = 4) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def response(page_id: int | None, url: str, payload: bytes) -> bytes:
    block = _HTTP % len(payload) + payload
    return _member([("WARC-Type", "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", _sha1(block)), ("WARC-Payload-Digest", _sha1(payload))], block)


def revisit(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """The payload's headers alone; its digest and length stand for it."""
    block = _HTTP % len(payload)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return _member([("WARC-Type", "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Profile", profile), ("WARC-Refers-To", _record_id(refers_to)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", _sha1(block)), ("WARC-Payload-Digest", _sha1(payload))], block)


class _File:
    """One file in the making: temporary name until it is closed."""

    def __init__(self, root: str, shard: int, seq: int):
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.shard, self.seq = shard, seq
        self.name = f"shard-{shard:06d}-{seq:05d}.warc.gz"
        self.path, self.temporary = f"{base}/{self.name}", f"{base}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.sha, self.bytes, self.records = hashlib.sha256(), 0, 0
        self.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def write(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return self.name, self.shard, self.seq, self.records, self.bytes, self.sha.hexdigest()


class Ranges:
    """Borders of the shards: a row's shard is the number of borders that are not above its key."""

    def __init__(self, sample: list[tuple[int | None, int, int]], shards: int):
        """sample: (page_id, hash, bytes); null ids come first."""
        keys = sorted((_LOW if p is None else p, h, b) for p, h, b in sample)
        total, before, borders = sum(b for *_, b in keys), 0, []
        for page, h, size in keys:
            if before * shards >= total * (len(borders) + 1) and len(borders) + 1 < shards:
                borders.append((page, h))
            before += size
        self.pages, self.hashes = (np.array([b[i] for b in borders], np.int64) for i in range(2))
        self.count = len(borders) + 1

    def shard(self, pages: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self.pages, pages, side) for side in ("left", "right"))
        for page in np.unique(pages[low < high]):  # at most one for each border
            of = pages == page
            a, b = low[of][0], high[of][0]
            low[of] = a + np.searchsorted(self.hashes[a:b], hashes[of], "right")
        return low


_LOW = -(1 << 63)


def _slots(spark: SparkSession, n: int) -> list[int]:
    """For each of n shards a key that Spark's hash partitioning into n puts into a task alone."""
    found: dict[int, int] = {}
    at = 0
    while len(found) < n:
        size = 16 * n + 64
        for r in spark.range(at, at + size).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("task")).groupBy("task").agg(F.min("id").alias("id")).collect():
            found.setdefault(r["task"], r["id"])
        at += size
    return [found[k] for k in range(n)]


MANIFEST = "file string, shard long, seq long, records long, bytes long, sha256 string"


def write_warc(pages: DataFrame, root: str, least: int = LEAST, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives below ``root``, a URI that every executor can write to; the manifest."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("sha"))
    narrow = materialize(rows.select("page_id", "sha", F.octet_length("html").cast("long").alias("bytes")), "warc_narrow")
    count, total = narrow.agg(F.count(F.lit(1)), F.sum(F.col("bytes") + 512)).first()
    size = min(shard_bytes, max((total or 0) // 64, 1 << 20))
    shards = max(1, -(-(total or 0) // size))
    key = F.xxhash64("sha")
    sample = narrow.filter(F.pmod(key, F.lit(max(1, count // (SAMPLES * shards)))) == 0).groupBy("page_id", key.alias("key")).agg(F.sum(F.col("bytes") + 512).alias("bytes"))
    ranges = Ranges([tuple(r) for r in sample.collect()], shards)
    slots = np.array(_slots(pages.sparkSession, ranges.count), np.int64)
    shared = pages.sparkSession.sparkContext.broadcast(ranges)

    @F.arrow_udf("long")
    def shard_of(page_id: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array(shared.value.shard(page_id.fill_null(_LOW).to_numpy(), key.to_numpy()))

    groups = narrow.filter(F.col("bytes") >= least).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = join_unique(narrow, materialize(groups, "warc_groups"), "sha", "n", count).filter("refers_to is not null and (page_id is null or page_id <> refers_to)")
    marks = again.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "refers_to", F.lit(0).alias("kind")).distinct()
    every = marks.unionByName(rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("kind", F.lit(1)))
    dealt = every.withColumn("shard", shard_of("page_id", F.xxhash64("sha")))
    task = F.element_at(F.lit(slots.tolist()), F.col("shard").cast("int") + 1)
    dealt = dealt.repartition(ranges.count, task).sortWithinPartitions("shard", "page_id", "kind", "sha", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done, now, marked, seen = None, [], object(), {}, set()
        for batch in batches:
            columns = (batch.column(n) for n in ("shard", "page_id", "kind", "sha", "refers_to", "url"))
            html = batch.column("html").cast(pa.binary())
            for i, (shard, page, kind, sha, refers, url) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                if page != now:
                    now, marked, seen = page, {}, set()
                if kind == 0:
                    marked[sha] = refers
                    continue
                if file is None or file.shard != shard or file.bytes >= roll_bytes:
                    if file:
                        done.append(file.close())
                    file = _File(root, shard, file.seq + 1 if file and file.shard == shard else 0)
                data = html[i].as_py()
                url = url if url is not None else f"urn:page:{'' if page is None else page}"
                url = url.replace("\r", "%0D").replace("\n", "%0A")
                if sha in marked:
                    file.write(revisit(page, url, data, marked[sha]))
                elif sha in seen and len(data) >= least:
                    file.write(revisit(page, url, data, page))
                else:
                    file.write(response(page, url, data))
                seen.add(sha)
        if file:
            done.append(file.close())
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=["file", "shard", "seq", "records", "bytes", "sha256"])

    pafs.FileSystem.from_uri(root)[0].create_dir(pafs.FileSystem.from_uri(root)[1], recursive=True)
    spark = pages.sparkSession
    manifest = dealt.mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts, rest = None, [], b""
    while True:
        data = rest or stream.read(1 << 20)
        rest = b""
        if not data:
            if z is not None:
                raise ValueError("the archive ends inside a record")
            return
        if z is None:
            z = zlib.decompressobj(31)
        parts.append(z.decompress(data))
        if z.eof:
            rest = z.unused_data
            yield b"".join(parts)
            z, parts = None, []


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != _sha1(block):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return headers, block


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_warc(manifest: DataFrame, root: str) -> DataFrame:
    """One row per record: of a response the digest and length of the payload itself, of a
    revisit those it was written with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(root)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in map(parse, members(stream)):
                        kind = headers["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        written = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != written or len(payload) != size):
                            raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
                        refers = headers.get("WARC-Refers-To")
                        rows.append((_page_id(headers["WARC-Record-ID"]), size, written, kind, _page_id(refers) if refers else None, headers["WARC-Target-URI"]))
                        if len(rows) >= 8192:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = manifest.count()
    return manifest.select("file").repartition(max(1, min(files, 4096)), "file").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    root = scratch_path(pages.sparkSession, "warc")
    if "://" not in root:
        root = root.replace("file:", "file://", 1) if root.startswith("file:") else f"file://{root}"
    return read_warc(write_warc(pages, root), root).drop("url")
