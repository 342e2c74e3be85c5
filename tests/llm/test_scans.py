import base64
import hashlib
import json
import random
import re
import sys
import time

import pytest
from pyspark.sql import functions as F

from voxelspark.llm import pii, secrets
from voxelspark.llm.pii import find_pii
from voxelspark.llm.secrets import scan_secrets

from .helpers import frame, rows

sys.set_int_max_str_digits(0)  # for the plain patterns
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

TEXTS = [
    None, "", "nothing here", "a@b@c.com x@y.z.w@q.r ..@..a.b a@@b.c", "é@ü.com a@b.c-d. " + "x" * 90 + "@h.c", "1.2.3.4.5.6.7.8 999.1.1.1.1 1.2.3",
    "+1 2 3 4 5 6 7 8 9 ( + +49 (30) 555-1234", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112", "call (499) 555-6503 or 499-555-6503", "jane(at)host.org", "on 2024-05-06 at 12:30, version 1.2.3, 12,345.67",
    "z" * 200000 + " +1 (743) 555-3824 " + "1" * 5000,
]


def brute_pii(text):
    out = []
    for k, p in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(c)))) for c in even)) % 10 == 0


def table(spark, texts):
    return frame(spark, [(i, t, "en", "s", 0, "", 0, 0) for i, t in enumerate(texts)])


def test_pii_base_spans_and_columns(spark):
    texts = TEXTS + [r[1] for r in rows()]
    got = {r.doc_id: r for r in find_pii(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        base = brute_pii(text)
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == j for b in base) for j in range(4)]
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
    assert find_pii(frame(spark, [])).count() == 0


def test_the_field_adds_spans_and_leaves_clean_text_alone():
    field = pii.trained()

    def found(text):
        return [(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans(text, pii.base_spans(text), field)]

    assert found("call (499) 555-6503 now") == [("phone", "(499) 555-6503")]
    assert found("see 555.123.4567, or tel: 555 123 4567") == [("phone", "555.123.4567"), ("phone", "555 123 4567")]
    assert found("jane(at)host.org") == [("email", "jane(at)host.org")]
    assert found("card 4111.1111.1111.1111 x") == [("card", "4111.1111.1111.1111")]
    for clean in ("2024-05-06 12:30", "order 1234567890", "10 000 000 000", "ISBN 978-3-16-148410-0", "12,345.67 of 1 2 3 4 5 6 7 8 9 10", "version 1.2.3"):
        assert found(clean) == []


def test_short_addresses_are_decoded_whatever_stands_beside_them():
    field = pii.trained()
    for text, want in (("host 10-0-0-1 is down", "10-0-0-1"), ("ip 8-8-8-8 and more", "8-8-8-8"), ("ip 8-8-8-8 and more, page 123", "8-8-8-8")):
        assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans(text, pii.base_spans(text), field)] == [("ip", want)]


def test_segment_model_agrees_with_enumeration():
    field = pii.SemiMarkov(sentences=6, epochs=1)
    text = "a 12 b"
    tokens = [m.span() for m in pii._TOKEN.finditer(text)]
    segs = [(i, j, [field.index.setdefault(f, 0) for f in pii._features(tokens, text, i, j)]) for i, j in pii._segments(tokens, text)]
    import itertools

    import numpy as np

    total, expected = [], np.zeros_like(field.bias)
    chosen = []
    for n in range(len(segs) + 1):
        for c in itertools.combinations(range(len(segs)), n):
            spans = sorted(segs[x][:2] for x in c)
            if all(a[1] <= b[0] for a, b in itertools.pairwise(spans)):
                for kinds in itertools.product(range(4), repeat=n):
                    total.append(sum(field.weights[k, segs[x][2]].sum() + field.bias[k] for x, k in zip(c, kinds, strict=True)))
                    chosen.append(np.bincount(kinds, minlength=4) if n else np.zeros(4))
    p = np.exp(np.array(total) - np.logaddexp.reduce(total))
    expected = (p[:, None] * np.array(chosen)).sum(0)
    assert -field._gradient(len(tokens), segs, {})[1] == pytest.approx(expected, abs=1e-6)


def tlv(tag, data):
    n = len(data)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(b := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + b
    return bytes([tag]) + size + data


RSA = tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, bytes([i + 1]) * 40) for i in range(8)))
EC = tlv(0x30, tlv(2, b"\1") + tlv(4, b"k" * 32) + tlv(0xA0, tlv(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
PKCS8 = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + tlv(5, b"")) + tlv(4, RSA))


def b64(data, url=False):
    return (base64.urlsafe_b64encode(data).rstrip(b"=") if url else base64.b64encode(data)).decode()


def test_secret_structures():
    token = ".".join((b64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode(), True), b64(b'{"sub":1}', True), "s" * 43))
    fake = ".".join((b64(b'{"algo":"x"}', True), b64(b"{}", True), "s" * 43))
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + b64(RSA) + "\n-----END RSA PRIVATE KEY-----"
    cases = {
        f"x {token} y": ["token"], f"x {fake} y": [], pem: ["pem"], f"key {b64(EC)} end": ["der"], f"key {PKCS8.hex()} end": ["hex"], f"key {PKCS8.hex().upper()} end": ["der", "hex"],
        f"key {b64(RSA[:-3])} end": [], f"key {b64(bytes(range(200)))} end": [], f"s {b64(b'openssh-key-v1' + bytes(1) + (b'\0\0\0\4none' * 2) + b'\0\0\0\0' + b'\0\0\0\1' + b'p' * 60)}": ["openssh"],
    }
    for text, want in cases.items():
        assert [secrets.KINDS[k] for _, k, _ in secrets.spans_of(text)[1]] == want, text[:60]


def test_secret_base_spans_and_columns(spark):
    texts = [None, "", 'TOKEN = "24be64439e3e49cf46b2"', "toKen=abcdefghijklmnop", "api_key:'short' apikey = abcdefghijkl", "AKIA" + "A" * 13 + " AKIA" + "B" * 14, "f" * 15 + " " + "a" * 16 + "G" + "0" * 40, "x" * 300000 + " secret=" + "q" * 50]
    texts += [r[1] for r in rows()]
    got = {r.doc_id: r for r in scan_secrets(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        base = sorted(
            [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 12]
            + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
            + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
        )
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(b[1] == j for b in base) for j in range(3))
    assert scan_secrets(frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text",
    ["1" * 1_000_000, "1." * 500_000, "9" * 5000 + ".1.1.1 " + "0" * 5000 + "1.2.3.4", "1 " * 50_000, "+" * 1_000_000, "+1" * 20_000, "a@" * 500_000, "@" * 1_000_000, "a." * 500_000 + "@x.y", "x" * 1_000_000 + "@", "1-" * 50_000, "(at)" * 20_000],
    ids=lambda t: t[:6],
)
def test_pii_is_linear_on_long_runs(text):
    began = time.perf_counter()
    base = pii.base_spans(text)
    pii.added_spans(text, base, pii.trained())
    assert time.perf_counter() - began < 20
    short = text[:5000] + text[-7000:]  # the plain patterns are quadratic
    assert pii.base_spans(short) == brute_pii(short)


def test_long_address_parts_and_chains():
    for text in ("1.2.3.4.5.6.7.8.9", "1.2.3.256.5.6.7.8", "000000255.1.1.1", "256.1.1.1.1", "1..2.3.4.5", "1.2.3.4.", ".1.2.3.4.5.6.7", "1.2.3"):
        assert pii.base_spans(text) == brute_pii(text), text


def test_many_base_and_added_spans_do_not_overlap():
    text = "a@b.co (743) 555-3824 1.2.3.4 " * 3000
    base = pii.base_spans(text)
    began = time.perf_counter()
    added = pii.added_spans(text, base, pii.trained())
    assert len(added) == 3000 and time.perf_counter() - began < 60
    marks = bytearray(len(text))
    for s, _, e in base:
        marks[s:e] = b"\1" * (e - s)
    assert not any(any(marks[s:e]) for s, _, e in added)


def test_decoding_is_the_best_of_all_segmentations():
    """Viterbi against enumeration, on the trained field and short texts."""
    field = pii.trained()
    for text in ("call (499) 555-6503", "ip 8-8-8-8 x", "jane(at)host.org", "12 34 56 78", "4111.1111.1111.1111", "1-2-3 4", "v1.2.3.4 of 5"):
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        best = {}
        for i, j in pii._segments(tokens, text):
            f = [field.index[x] for x in pii._features(tokens, text, i, j) if x in field.index]
            best[i, j] = float((field.weights[:, f].sum(1) + field.bias).max())

        def total(spans, best=best, tokens=tokens):
            at = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
            return sum(best[at[0][s], at[1][e]] for s, _, e in spans)

        def enumerated(i, best=best, n=len(tokens)):
            if i == n:
                return 0.0
            return max([enumerated(i + 1), *(s + enumerated(b) for (a, b), s in best.items() if a == i)])

        assert total(field.decode(text)) == pytest.approx(enumerated(0))


def test_added_spans_on_generated_sentences():
    """Recall and precision over sentences of another seed than the field was trained on."""
    field, right, found, gold = pii.trained(), 0, 0, 0
    for text, want in pii._sentences(random.Random(99), 400):
        base = {(s, e) for s, _, e in pii.base_spans(text)}
        want = {x for x in want if (x[0], x[2]) not in base}
        got = set(pii.added_spans(text, pii.base_spans(text), field))
        right, found, gold = right + len(got & want), found + len(got), gold + len(want)
    assert right / gold > 0.97 and right / found > 0.97, (right, found, gold)


NESTED = b'{"alg":"HS256","x":' + b"[" * 200_000 + b"]" * 200_000 + b"}"


@pytest.mark.parametrize(
    "text",
    ["eyJ" * 330_000, "eyJabcdefgh." * 80_000, "-----BEGIN RSA PRIVATE KEY-----\n" * 30_000, "-----BEGIN " + "A " * 500_000, "-----END RSA PRIVATE KEY-----" * 30_000, "password " * 100_000, "AKIA" * 250_000, "ab1" * 330_000, ("A" * 64 + "\n") * 15_000, "token=" * 150_000,
     b64(NESTED, True) + "." + b64(NESTED, True) + "." + "s" * 43, "-----BEGIN PRIVATE KEY-----" + "\\n" * 400_000, ("f" * 20 + " ") * 40_000],
    ids=lambda t: t[:12].strip(),
)
def test_secrets_are_linear_on_long_runs(text):
    began = time.perf_counter()
    base, every = secrets.spans_of(text)
    assert time.perf_counter() - began < 20
    assert base == every


def test_keys_in_source_text_and_wrapped():
    lines = [b64(PKCS8)[i : i + 64] for i in range(0, len(b64(PKCS8)), 64)]
    head, tail = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    cases = {
        '{"key": "' + "\\n".join([head, *lines, tail]) + '\\n"}': ["pem"], "\r\n".join([head, *lines, tail]): ["pem"], "k:\n" + "\n".join(lines) + "\nend": ["der"],
        "\n".join([head, head, *lines, tail]): ["pem"], "\n".join([head, *lines]) + "\n" + tail.replace("PRIVATE", "RSA PRIVATE"): ["der"], "0x" + EC.hex().upper(): ["der"], "\n".join([head, "not a key", tail]): [],
    }
    for text, want in cases.items():
        assert [secrets.KINDS[k] for _, k, _ in secrets.spans_of(text)[1] if k > 2] == want, text[:80]


def test_scans_ignore_clashing_columns(spark):
    docs = table(spark, ["call (499) 555-6503", None]).withColumn("spans", F.lit("x")).withColumn("base_sha256", F.lit(1)).withColumn("n_hex", F.lit(2)).withColumn("n_ip", F.lit(3))
    assert find_pii(docs).columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    assert {r.doc_id: r.spans for r in find_pii(docs).collect()} == {0: "phone:5:19", 1: ""}
    assert {r.n_hex for r in scan_secrets(docs).collect()} == {0}
