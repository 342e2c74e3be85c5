"""Personal data by a semi-Markov conditional random field.

Base patterns give the spans of four kinds. What they leave is decoded by a semi-Markov CRF: a
candidate segment is up to ``MAX_TOKENS`` tokens long and scored as a whole (digit grouping,
check digit, separators, the domain's shape, the word before it), and Viterbi over segments
chooses boundaries and kinds together. So a phone number without its plus sign, a card with
other separators or a spelled-out e-mail address is found, and a date or version is not.

The field is trained when an operator is built: conditional log-likelihood by forward-backward
over sentences generated from templates with a fixed seed. It runs on the neighbourhoods of
digits (four at least, as no kind has fewer), at signs and spelled-out ones only; elsewhere no
segment has a feature.

Defined results: null counts as empty; base spans stay as they are and added ones never overlap
them; repeated rows give equal rows; an empty table gives an empty result; extra columns are
ignored, whatever their names. Texts are scanned whole, in time linear in their length, runs of any
length included; memory is that of one text. A token of more than ``LONGEST_TOKEN`` characters is
part of no added span.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .secrets import joined
from .textkit import pieces

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
#: The shortest kind without an at sign is an address of four numbers.
LEAST_DIGITS = 4
LONGEST_TOKEN = 128
#: The most numbers that a phone number, card or address is written in.
MOST_GROUPS = 6
_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: Numbers joined by dots, as many as there are; possessive, so that a long run is read once.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TRIGGER = re.compile(r"[0-9]+|@|[\[({<](?:at|AT)[\])}>]")
_AT = re.compile(r"@|[\[({<](?:at|AT)[\])}>]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]", re.U)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping by kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        local = _LOCAL.search(text, _run_start(text, at, last), at)
        if local and (m := _EMAIL_DOMAIN.match(text, at)):
            found.append((local.start(), 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if "." in text:
        found += [(s, 1, e) for s, e in _addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers joined by dots, each at most 255. A longer chain is read four numbers at a
    time, as leftmost matches that do not overlap are."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(d := p.lstrip("0")) < 4 and int(d or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _run_start(text: str, at: int, last: int) -> int:
    i = at
    while i > last and text[i - 1] in _LOCAL_CHARS:
        i -= 1
    return i


# --- segments and their features


_CUES = {
    "email": "mail", "e": "mail", "mail": "mail", "contact": "mail", "write": "mail",
    "ip": "host", "host": "host", "server": "host", "address": "host",
    "card": "card", "visa": "card", "mastercard": "card", "amex": "card", "credit": "card",
    "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "cell": "phone", "telefon": "phone",
    "version": "not", "v": "not", "section": "not", "isbn": "not", "order": "not", "page": "not", "no": "not", "id": "not", "item": "not",
}
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\s*[\[({<](?:at|AT)[\])}>]\s*[A-Za-z0-9-]+((?:\.|\s\.\s|\s*[\[({<](?:dot|DOT)[\])}>]\s*)[A-Za-z0-9-]+)+")
#: The domain goes on after the span.
_MORE = re.compile(r"\.[A-Za-z0-9]|\s\.\s[A-Za-z0-9]|\s*[\[({<](?:dot|DOT)[\])}>]")
_GROUPS_PHONE = {"3-3-4", "2-4-4", "3-4-4", "3-3-2-2", "1-3-3-4", "2-3-4", "4-3-3", "3-4", "2-2-2-2-2", "4-6", "5-6", "3-7"}


@functools.lru_cache(maxsize=1 << 16)
def _shape(span: str) -> list[str]:
    """Features that do not depend on which digits the span has; it is given with zeros."""
    groups = _DIGITS.findall(span)
    n = sum(map(len, groups))
    letters = sum(c.isalpha() for c in span)
    seps = "".join(sorted({c for c in span if not c.isalnum()}))
    out = [f"digits={min(n, 20)}", f"letters={letters > 0}", f"seps={seps[:6]}", f"first={'d' if span[0].isdigit() else 'a' if span[0].isalpha() else span[0]}", f"last={'d' if span[-1].isdigit() else 'a' if span[-1].isalpha() else 'o'}"]
    shape = "-".join(str(len(g)) for g in groups)
    out.append(f"phone={shape in _GROUPS_PHONE and not letters}")
    out.append(f"paren={bool(re.match(r'\(\d{2,4}\)\s?\d', span))}")
    out.append(f"four={shape in ('4-4-4-4', '4-6-5')}")
    out.append(f"spelled={bool(_SPELLED.fullmatch(span))}")
    out.append(f"balance={span.count('(') == span.count(')') and span.count('[') == span.count(']')}")
    return out


_ZEROS = str.maketrans("123456789", "000000000")


def _values(span: str) -> list[str]:
    """Features of the digits themselves."""
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    letters = any(c.isalpha() for c in span)
    octets = len(groups) == 4 and not letters and all(len(g) < 4 and int(g) < 256 for g in groups) and len({c for c in span if not c.isalnum()}) == 1
    return [f"luhn={12 <= len(digits) <= 19 and not letters and luhn(digits)}", f"octets={octets}"]


def _around(tokens: list[tuple[int, int]], text: str, i: int, j: int) -> list[str]:
    """Features of the word before and of the characters beside."""
    before = ""
    for k in range(i - 1, max(-1, i - 4), -1):
        w = text[tokens[k][0] : tokens[k][1]].lower()
        if w.isalpha():
            before = _CUES.get(w, "word")
            break
    left = tokens[i][0] > 0 and text[tokens[i][0] - 1]
    right = tokens[j - 1][1] < len(text) and text[tokens[j - 1][1]]
    more = f"more={bool(_MORE.match(text, tokens[j - 1][1]))}"
    return [f"cue={before}", more, f"edge={bool(left) and (left.isalnum() or left in '-.@/+_')}{bool(right) and (right.isalnum() or right in '-@/_')}"]


def _features(tokens: list[tuple[int, int]], text: str, i: int, j: int) -> list[str]:
    span = text[tokens[i][0] : tokens[j - 1][1]]
    return [*_shape(span.translate(_ZEROS)), *_values(span), *_around(tokens, text, i, j)]


def _segments(tokens: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    """Candidate segments. They start and end at digits, letters or an opening bracket or plus
    sign, do not run over a line's end, and are such as some kind can be: with a spelled-out at
    sign, or without letters, with at most ``MOST_GROUPS`` numbers and with seven digits to
    nineteen or four numbers."""
    n = len(tokens)
    spelled = [text[s:e] in ("at", "AT") and s > 0 and text[s - 1] in "[({<" for s, e in tokens]
    ahead, out = [n] * (n + 1), []
    for i in range(n - 1, -1, -1):
        ahead[i] = i if spelled[i] else ahead[i + 1]
    for i, (s, e) in enumerate(tokens):
        if not (text[s].isalnum() or text[s] in "(+") or e - s > LONGEST_TOKEN:
            continue
        digits, groups, letters, at, may = 0, 0, False, False, ahead[i] < i + MAX_TOKENS
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            a, b = tokens[j - 1]
            if b - a > LONGEST_TOKEN or (j - 1 > i and "\n" in text[tokens[j - 2][1] : a]):
                break
            if "0" <= text[a] <= "9":
                digits, groups = digits + b - a, groups + 1
            elif text[a].isalpha():
                letters, at = True, at or spelled[j - 1]
            numbers = not letters and digits <= 19 and groups <= MOST_GROUPS
            if not (may or numbers):
                break
            if (at or (numbers and (digits >= 7 or groups == 4))) and text[b - 1].isalnum():
                out.append((i, j))
    return out


class SemiMarkov:
    """A semi-Markov CRF with the kinds above and an outside label for single tokens."""

    def __init__(self, seed: int = 5, sentences: int = 220, epochs: int = 14):
        self.index: dict[str, int] = {}
        data = []
        for text, gold in _sentences(random.Random(seed), sentences):
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            segs = [(i, j, [self.index.setdefault(f, len(self.index)) for f in _features(tokens, text, i, j)]) for i, j in _segments(tokens, text)]
            starts, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
            data.append((len(tokens), segs, {(starts[s], ends[e]): k for s, k, e in gold}))
        self.weights = np.zeros((len(KINDS), len(self.index)))
        self.bias = np.full(len(KINDS), -1.0)
        total, total_b = np.full_like(self.weights, 1e-3), np.full_like(self.bias, 1e-3)
        for _ in range(epochs):
            for n, segs, gold in data:
                grad, grad_b = self._gradient(n, segs, gold)
                total += grad * grad
                total_b += grad_b * grad_b
                self.weights += 0.4 * (grad - 1e-3 * self.weights) / np.sqrt(total)
                self.bias += 0.4 * grad_b / np.sqrt(total_b)

    def _gradient(self, n: int, segs: list, gold: dict) -> tuple[np.ndarray, np.ndarray]:
        """Observed minus expected features, by forward-backward over segments."""
        scores = [self.weights[:, f].sum(1) + self.bias for _, _, f in segs]
        into, out = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for x, (i, j, _) in enumerate(segs):
            into[j].append((i, x))
            out[i].append((j, x))
        each = [float(np.logaddexp.reduce(s)) for s in scores]

        def lse(values: list[float]) -> float:
            top = max(values)
            return top + math.log(sum(math.exp(v - top) for v in values))

        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            alpha[j] = lse([alpha[j - 1], *(alpha[i] + each[x] for i, x in into[j])])
        for i in range(n - 1, -1, -1):
            beta[i] = lse([beta[i + 1], *(beta[j] + each[x] for j, x in out[i])])
        grad, grad_b = np.zeros_like(self.weights), np.zeros_like(self.bias)
        for x, (i, j, f) in enumerate(segs):
            p = np.exp(np.minimum(alpha[i] + scores[x] + beta[j] - alpha[n], 0.0))
            d = -p
            if (i, j) in gold:
                d[gold[i, j]] += 1
            if np.abs(d).max() > 1e-6:
                for c in f:
                    grad[:, c] += d
                grad_b += d
        return grad, grad_b

    def _score(self, names: list[str]) -> tuple[float, ...]:
        f = [c for c in map(self.index.get, names) if c is not None]
        return tuple((self.weights[:, f].sum(1)).tolist())

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """The best segmentation's spans."""
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        n, into, bias = len(tokens), {}, self.bias.tolist()
        shapes, around = functools.lru_cache(maxsize=4096)(lambda z: self._score(_shape(z))), {}
        for i, j in _segments(tokens, text):
            span = text[tokens[i][0] : tokens[j - 1][1]]
            parts = [shapes(span.translate(_ZEROS))]
            for names in (tuple(_values(span)), tuple(_around(tokens, text, i, j))):
                if names not in around:
                    around[names] = self._score(list(names))
                parts.append(around[names])
            s = [sum(x) for x in zip(bias, *parts, strict=True)]
            k = max(range(len(KINDS)), key=s.__getitem__)
            if s[k] > 0:
                into.setdefault(j, []).append((s[k], i, k))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for s, i, k in into.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k)
        spans, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                spans.append((tokens[i][0], k, tokens[j - 1][1]))
                j = i
        return spans[::-1]


def _sentences(rng: random.Random, count: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Generated training sentences and their gold spans."""
    words = "the of was on in these people new house may that for all over tion ering ndo lich keit est una para nous vous avec".split()
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: rng.choice(words)

    def card(sep: str) -> str:
        body = rng.choice("3456") + d(14)
        digit = next(c for c in "0123456789" if luhn(body + c))
        full = body + digit
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def bad_card() -> str:
        while luhn(full := rng.choice("3456") + d(15)):
            pass
        return full

    def spelled() -> str:
        a, b = rng.choice(["[at]", "(at)", "{at}", "<at>", "[AT]"]), rng.choice(["[dot]", "(dot)", ".", "[DOT]"])
        if rng.random() < 0.25:
            return f"{w()}.{w()} {a} {w()} {b} {w()} {b} com"
        return f"{w()}.{w()} {a} {w()}{b}{rng.choice(['com', 'org', 'example.net'])}" if rng.random() < 0.5 else f"{w()}{d(2)} {a} {w()} {b} com"

    good = [
        (3, lambda: f"({d(3)}) {d(3)}-{d(4)}"), (3, lambda: f"{d(3)}-{d(3)}-{d(4)}"), (3, lambda: f"{d(3)}.{d(3)}.{d(4)}"), (3, lambda: f"1-{d(3)}-{d(3)}-{d(4)}"), (3, lambda: f"{d(3)} {d(3)} {d(4)}"),
        (0, spelled), (0, spelled), (2, lambda: card(".")), (2, lambda: card("/")), (2, lambda: card("_")), (2, lambda: card("")),
        (1, lambda: "-".join(str(rng.randrange(256)) for _ in range(4))),
    ]
    bad = [
        lambda: f"20{d(2)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}", lambda: f"{rng.randrange(10, 24)}:{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(3)}", lambda: f"{d(2)},{d(3)}.{d(2)}", lambda: f"{d(4)}", lambda: f"{rng.randrange(10, 29)}.{rng.randrange(10, 13)}.20{d(2)}",
        lambda: f"{d(2)}-{d(2)}", lambda: f"{d(8)}", lambda: f"{d(10)}", bad_card, lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{d(3)} of {d(3)}", lambda: f"v{d(1)}.{d(1)}.{d(1)}.{d(1)}", lambda: f"{w()}@{w()}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(3)}-{d(2)}",
        lambda: f"{d(1)} {d(3)} {d(3)} {d(3)}", lambda: f"({d(4)}) {d(2)}", lambda: f"{w()} {d(2)} at {w()}", lambda: f"#{d(6)}", lambda: f"{d(12)}{rng.choice('abc')}{d(3)}", lambda: f"{w()}{d(3)}-{d(3)}-{d(4)}{w()}",
    ]
    cues = {0: ["mail", "contact"], 1: ["host", "ip"], 2: ["card", "visa"], 3: ["call", "tel", "phone"]}
    for _ in range(count):
        text, gold = "", []
        for _ in range(rng.randrange(1, 4)):
            text += " ".join(w() for _ in range(rng.randrange(1, 4))) + " "
            if rng.random() < 0.5:
                kind, make = rng.choice(good)
                if kind == 1 or rng.random() < 0.3:
                    text += rng.choice(cues[kind]) + rng.choice([" ", ": "])
                value = make()
                gold.append((len(text), kind, len(text) + len(value)))
            else:
                if rng.random() < 0.3:
                    text += rng.choice(["version", "order", "no", "isbn", "page"]) + " "
                value = rng.choice(bad)()
            text += value + rng.choice([" ", ", ", ". ", "\n"])
        yield text, gold


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiMarkov, margin: int = 60) -> list[tuple[int, int, int]]:
    """What the field finds beside the base spans: each neighbourhood of a trigger, cut at base
    spans, is decoded once."""
    covered = sorted((s, e) for s, _, e in base)
    reach = list(itertools.accumulate((e for _, e in covered), max))  # the furthest end so far
    regions: list[list[int]] = []
    c = 0
    for m in _TRIGGER.finditer(text):
        s, e = m.span()
        while c < len(covered) and covered[c][1] <= s:
            c += 1
        if c < len(covered) and covered[c][0] < e:
            continue
        low, high = max(0, s - margin), min(len(text), e + margin)
        if c and covered[c - 1][1] > low:
            low = covered[c - 1][1]
        if c < len(covered) and covered[c][0] < high:
            high = covered[c][0]
        if regions and low <= regions[-1][1]:
            regions[-1][1] = max(high, regions[-1][1])
        else:
            regions.append([low, high])
    out = []
    for low, high in regions:
        if sum(x.isdigit() for x in text[low:high]) >= LEAST_DIGITS or _AT.search(text, low, high):
            while low > 0 and high - low < 4096 and text[low - 1].isalnum() and text[low].isalnum():
                low -= 1
            while high < len(text) and high - low < 4096 and text[high].isalnum() and text[high - 1].isalnum():
                high += 1
            out += [(low + s, k, low + e) for s, k, e in model.decode(text[low:high])]
    before = [bisect.bisect_left(covered, (e,)) for _, _, e in out]  # base spans that start before the end
    return [x for x, n in zip(out, before, strict=True) if not n or reach[n - 1] <= x[0]]


@functools.cache
def trained() -> SemiMarkov:
    """The field with its fixed seed; trained once in a process."""
    return SemiMarkov()


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = []
                for text in piece.column("text").to_pylist():
                    base = base_spans(text or "")
                    more = added_spans(text or "", base, field)
                    kinds = [k for _, k, _ in base]
                    rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base, KINDS).encode()).hexdigest(), joined(sorted([*base, *more]), KINDS), len(more)))
                types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([piece.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
