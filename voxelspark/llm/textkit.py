"""Vectorised words and shingle hashes over Arrow string arrays.

A word is hashed from its bytes by a polynomial in a fixed odd 64-bit base, summed with
``cumsum`` modulo 2**64, so that neither words nor documents need a Python loop. Text is
taken in pieces that end between words: memory follows the batch's words, not its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_PIECE = 1 << 18
_SHINGLE = 0xD6E8FEB86659FD93
_powers: tuple[np.ndarray, np.ndarray] | None = None

#: [^\x20\x09-\x0D]+ over UTF-8 bytes.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters and digits; every byte of a character beyond ASCII counts as a letter.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("A") : ord("Z") + 1] = ALNUM[ord("a") : ord("z") + 1] = ALNUM[128:] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 2 * _PIECE)
        tables = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers = tables[0], tables[1]
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets into them; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """hash, start and end byte of each word, and first[i]:first[i + 1], the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool = True):
        n, hashes, starts, ends = len(data), [], [], []
        heads = np.zeros(n + 1, dtype=bool)
        heads[offsets] = True
        at = 0
        while at < n:
            to = min(n, at + _PIECE)
            while to < n and word[data[to]] and word[data[to - 1]] and not heads[to]:
                step = min(n, to + _PIECE)
                stop = np.flatnonzero(~word[data[to:step]] | heads[to:step])
                to = to + int(stop[0]) if len(stop) else step
            piece, head = data[at:to], heads[at:to]
            inside = word[piece]
            first = inside.copy()
            first[1:] &= ~inside[:-1] | head[1:]
            last = inside.copy()
            last[:-1] &= ~inside[1:] | head[1:]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            if len(s):
                power, inverse = _pow(len(piece))
                c = (_LOWER[piece] if lower else piece.astype(np.uint64)) + np.uint64(1)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * inverse[: len(piece)], dtype=np.uint64)))
                hashes.append(mix((total[e] - total[s]) * power[s] + (e - s).astype(np.uint64)))
                starts.append(s + at)
                ends.append(e + at)
            at = to
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Of a whole word sequence, its length included."""
    h = np.uint64(len(words) + 1)
    for w in words:
        h = mix(np.array([h], np.uint64) * np.uint64(_SHINGLE) + w)[0]
    return h


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; run i starts at word i (runs over text borders included)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(_SHINGLE) + words[i : i + n]
    return mix(h)


def shingles_by_text(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: fewer words than k make one shingle."""
    words = Words(*buffers(texts), NON_SPACE)
    runs = shingle_hashes(words.hash, k)
    first = words.first.tolist()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield np.array([sequence_hash(words.hash[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _cuts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    sizes = np.diff(buffers(texts)[1])
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield at, i - at
            at, total = i, 0
        total += size
    if at < len(texts):
        yield at, len(texts) - at


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (one text at least)."""
    for at, n in _cuts(batch.column(batch.schema.get_field_index(column)), most):
        yield batch.slice(at, n)


def array_pieces(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of an array with about ``most`` bytes of text each (one text at least)."""
    for at, n in _cuts(texts, most):
        yield texts.slice(at, n)
