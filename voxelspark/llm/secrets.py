"""Secret scan with structural confirmation.

Base patterns give the spans of three kinds (assign, access, hex). Beyond them, runs of base64
or hex characters are decoded and reported only if their bytes have the structure of a secret:

* der     - DER key encodings: nested tag-length-value items whose lengths close exactly, in the
            shape of an RSA, EC, PKCS#8 or encrypted private key
* openssh - the OpenSSH private key container
* token   - three dot-joined base64url parts of which the first decodes to a JSON object with a
            known "alg"
* pem     - a PEM block whose body decodes to one of the above; line ends may be written as \\n,
            as in JSON or source text

Wrapped base64 is joined before it is decoded. Scanning is one pass over whole texts without a
shuffle, in time linear in their length, unclosed blocks, long runs and deeply nested payloads
included. Defined results: null counts as empty; overlapping spans of different kinds are all
reported, except that an added span inside another one is left out; repeated rows give equal rows;
an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import binascii
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textkit import pieces

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "token", "openssh", "der")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}+")
#: Lines of base64 of a usual width, then the last one.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{48,76}+(?:\r?\n|\\n))++(?:[A-Za-z0-9+/]++={0,2}+)?")
_CHAIN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]++")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_END = re.compile(r"-----END ([A-Z0-9 ]*PRIVATE KEY)-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s:,\\.-]*+")
_ALGORITHMS = {"HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES384", "ES512", "PS256", "PS384", "PS512", "EdDSA", "none"}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def decode(run: str) -> Iterator[bytes]:
    """The bytes a run may stand for, as hex and as either base64 alphabet."""
    if len(run) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", run):
        yield bytes.fromhex(run)
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 != 1:
        try:
            yield base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            return


def _items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The DER items that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_private_der(data: bytes) -> bool:
    """A SEQUENCE whose nested lengths close and whose members are those of a private key."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = _items(data)
    if not top or len(top) != 1:
        return False
    inner = _items(top[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    version = inner[0][1] if tags[0] == 0x02 else None
    if version in (b"\0", b"\1") and len(tags) >= 9 and tags[:9] == [0x02] * 9:
        return True  # RSA: version and eight integers
    if version == b"\0" and len(tags) >= 6 and tags == [0x02] * 6:
        return True  # DSA
    if version in (b"\0", b"\1") and len(tags) >= 3 and tags[1:3] == [0x30, 0x04]:
        return bool((a := _items(inner[1][1])) and a[0][0] == 0x06)  # PKCS#8
    if version == b"\1" and len(tags) >= 2 and tags[1] == 0x04 and len(inner[1][1]) in (28, 32, 48, 66):
        return all(t in (0xA0, 0xA1) for t in tags[2:])  # EC
    if tags == [0x30, 0x04]:
        return bool((a := _items(inner[0][1])) and a[0][0] == 0x06 and a[0][1].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01\x05"))  # encrypted PKCS#8
    return False


def is_openssh(data: bytes) -> bool:
    """The container's magic, then length-prefixed cipher, KDF name and options that fit."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at = 15
    for _ in range(3):
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        if size > len(data) or at > len(data):
            return False
    return int.from_bytes(data[at : at + 4], "big") >= 1


def is_token(run: str) -> bool:
    """A signed token: the first part is a JSON header with a known algorithm, the second JSON."""
    head, body, sign = run.split(".")
    parts = []
    for part in (head, body):
        if len(part) % 4 == 1:
            return False
        try:
            parts.append(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))))
        except (ValueError, binascii.Error, RecursionError):
            return False
    ok = isinstance(parts[0], dict) and isinstance(parts[1], dict) and parts[0].get("alg") in _ALGORITHMS
    return ok and (len(sign) >= 16 or parts[0]["alg"] == "none")


def _pem_spans(text: str) -> Iterator[tuple[int, int]]:
    """From the last BEGIN line before each END line of the same label, if the body is a key."""
    begins = list(_BEGIN.finditer(text))
    starts, least = [m.start() for m in begins], 0
    for end in _END.finditer(text) if begins else ():
        n = bisect.bisect_left(starts, end.start())
        begin, least, was = begins[n - 1] if n else None, end.end(), least
        if begin is None or begin.start() < was or begin[1] != end[1] or begin.end() > end.start() or not _BODY.fullmatch(text, begin.end(), end.start()):
            continue
        lines = text[begin.end() : end.start()].replace("\\r", "").replace("\\n", "\n").split("\n")
        body = "".join(line.strip() for line in lines if ":" not in line and "," not in line)
        if any(is_private_der(d) or is_openssh(d) for d in decode(body)) or (any("ENCRYPTED" in line for line in lines) and len(body) >= 64):
            yield begin.start(), end.end()


def _token_spans(text: str) -> Iterator[tuple[int, int]]:
    """Three parts of a dotted chain, of which the first holds a JSON header."""
    for m in _CHAIN.finditer(text):
        if "eyJ" not in m[0]:
            continue
        parts = m[0].split(".")
        at = list(itertools.accumulate((len(p) + 1 for p in parts), initial=m.start()))
        i = 0
        while i + 2 < len(parts):
            k = parts[i].find("eyJ")
            if k >= 0 and len(parts[i]) - k >= 11 and parts[i + 1] and is_token(".".join((parts[i][k:], parts[i + 1], parts[i + 2]))):
                yield at[i] + k, at[i + 2] + len(parts[i + 2])
                i += 3
            else:
                i += 1


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the runs whose structure is confirmed."""
    found = []
    if "-----BEGIN " in text:
        found += [(s, 3, e) for s, e in _pem_spans(text)]
    if "eyJ" in text:
        found += [(s, 4, e) for s, e in _token_spans(text)]
    for pattern in (_WRAPPED, _RUN):
        for m in pattern.finditer(text):
            skip = 2 * (m[0][:2] in ("0x", "0X"))
            run = m[0][skip:] if pattern is _RUN else re.sub(r"\r?\n|\\n", "", m[0])
            for data in decode(run):
                kind = 5 if is_openssh(data) else 6 if is_private_der(data) else 0
                if kind:
                    found.append((m.start() + (skip if pattern is _RUN else 0), kind, m.end()))
                    break
    return found


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: an added one inside another span is left out, of added ones the
    longer stays."""
    base = base_spans(text)
    taken, reach = sorted(base), 0
    starts, ends = [s for s, _, _ in taken], list(itertools.accumulate((e for _, _, e in taken), max))
    for s, k, e in sorted(confirmed_spans(text), key=lambda x: (x[0], -x[2], x[1])):
        n = bisect.bisect_right(starts, s)  # base spans that start no later
        if e > reach and not (n and ends[n - 1] >= e):
            taken.append((s, k, e))
            reach = e
    return base, sorted(taken)


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = []
                for text in piece.column("text").to_pylist():
                    base, every = spans_of(text or "")
                    kinds = [k for _, k, _ in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base, KINDS).encode()).hexdigest(), joined(every, KINDS), len(every) - len(base)))
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)
                yield pa.record_batch([piece.column("doc_id"), *(pa.array(c, t) for c, t in columns)], names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
