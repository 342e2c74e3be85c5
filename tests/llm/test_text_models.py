import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelspark.llm import textkit
from voxelspark.llm.decontaminate import RADIUS, Items, contaminated, drop_contaminated, fingerprints
from voxelspark.llm.language import DICTIONARY, dictionaries, identify_language
from voxelspark.llm.ngram_join import _sketch, differing
from voxelspark.llm.quality import HELD_OUT, estimated_prior, features, keep_good, quality_scores

from .helpers import SCHEMA, frame, prose, rows


def test_words_match_python_splitting():
    texts = ["", None, "  a  B\tc\n", "ÀÉ straße\x0b x", "z" * 700000 + " end", "one", *(r[1] for r in rows())]
    words = textkit.Words(*textkit.buffers(pa.array(texts)), textkit.NON_SPACE)
    seen = {}
    for i, text in enumerate(texts):
        own = [w.lower() for w in (text or "").encode().split()]
        got = words.hash[words.first[i] : words.first[i + 1]].tolist()
        assert len(got) == len(own)
        for w, h in zip(own, got, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n, m in ((10, 12), (500, 480), (900, 1100), (5000, 5000)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[: n // 2], rng.integers(0, 2**63, m - n // 2).astype(np.uint64)))
        true = len(set(a.tolist()) ^ set(b.tolist()))
        assert true * 0.4 < differing(_sketch(a), _sketch(b)) <= true
        assert differing(_sketch(a), _sketch(a)) == 0


def test_language_on_held_out_texts(spark):
    rng = random.Random(1)
    stems = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "ogni cosa parla della notte bianca".split(), "cc": "krz szcz prz brzeg chrzan wrzos".split()}
    data = [(i, " ".join(rng.choice(stems[lang]) + rng.choice(["", "er", "ung"]) for _ in range(rng.randrange(20, 200))), lang, "s", 0, "", 0, 0) for i, lang in ((i, "abc"[i % 3] * 2) for i in range(600))]
    data += [(1000, None, "aa", "s", 0, "", 0, 0), (1001, "123 !!", None, "s", 0, "", 0, 0), (1002, "", None, "s", 0, "", 0, 0), (None, "krz brzeg " * 40000, None, "s", 0, "", 0, 0)]
    got = {r.doc_id: r for r in identify_language(frame(spark, data)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(600))
    assert np.mean([got[i].lang_pred == "abc"[i % 3] * 2 for i in held]) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[None].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = identify_language(frame(spark, [(1, "text", None, "s", 0, "", 0, 0)])).first()
    assert nothing.lang_pred == "und"
    assert identify_language(frame(spark, [])).count() == 0


def test_every_language_is_learned(spark):
    """260 languages, more than one block of encoders; the last sixty are rarer."""
    rng = random.Random(8)
    learn = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5]
    held = (i for i in range(3000, 9000) if zlib.crc32(str(i).encode()) % 5 == 0)
    data, ask = [], {}
    for n in range(260):
        stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        text = lambda: " ".join(rng.choice(stems) for _ in range(60))  # noqa: B023, E731
        data += [(learn.pop(), text(), f"l{n:03d}", "s", 0, "", 0, 0) for _ in range(2 if n < 200 else 1)]
        if n % 20 == 0 or n >= 250:
            ask[i := next(held)] = f"l{n:03d}"
            data.append((i, text(), None, "s", 0, "", 0, 0))
    got = {r.doc_id: r.lang_pred for r in identify_language(frame(spark, data)).collect()}
    assert {i: got[i] for i in ask} == ask


def test_dictionaries_hold_bodies_of_all_sampled_documents(spark):
    """Texts open with the same 1600 characters; each body has a word of its own."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "q"
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:256]
    content = dictionaries(frame(spark, [(i, "licence " * 200 + (name(i) + " ") * 2000, "en", "s", 0, "", 0, 0) for i in ids]))["en"]
    words = set(content.decode().split())
    assert DICTIONARY * 0.98 <= len(content) <= DICTIONARY
    assert sum(name(i) in words for i in ids) > 200


def corpus(n=900):
    rng = random.Random(2)
    data, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randrange(30, 200)).capitalize() + "."
        bad = i % 6 == 0
        if bad:
            w = text.split()
            text = [" ".join(x.upper() + "!!" for x in w), " ".join(x + "###" for x in w), " ".join(w[:5] * 20), " | ".join(w)][i // 6 % 4]
        data.append((i, text, "en", "s", 0, "", 0, 0))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return data, labels


def test_quality_learns_and_filters(spark):
    data, labels = corpus()
    docs = frame(spark, data + [(5000, None, None, None, None, None, None, None), (None, "x " * 100000, "en", "s", 0, "", 0, 0)])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(docs, table).collect()}
    assert len(got) == len(data) + 2
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == HELD_OUT)
    held = [i for i, q, _ in labels if got[i].held_out]
    truth = {i: q for i, q, _ in labels}
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    kept = keep_good(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality_scores(frame(spark, []), table).count() == 0
    none = quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in none.collect()} == {0.5}


def test_features_are_the_texts_own():
    texts = ["Some words, here. And here!", "", "a a a a b", "z" * 100]
    together = features(pa.array(texts))
    for i, t in enumerate(texts):
        np.testing.assert_allclose(features(pa.array([t]))[0], together[i])


def brute_features(text):
    """The statistics of one text, counted plainly."""
    data, words = (text or "").encode(), [w.lower() for w in (text or "").encode().split()]
    raw = (text or "").encode().split()
    size, many = max(len(data), 1), max(len(words), 1)
    inner = b".,;:'\"()-"
    kinds = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!?", inner, bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b"!?" + inner), b"\n\r"]
    ends = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in inner + b"?")
    grams = {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
    return [
        *(sum(c in k for c in data) / size for k in kinds), np.log1p(len(words)), sum(map(len, raw)) / many / 10, sum(w[-1] in ends for w in raw) / many, sum(len(w) == 1 for w in raw) / many,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / many, len(set(words)) / many * np.log1p(many) / 6, len(grams) / many, float(not words),
    ]


def test_features_match_plain_counts():
    texts = ["One two, three! (four) five? six", "", None, "a A a a b b", "\n\n x\ty\r\n", "ÀÉ 12,5 $$ straße", "w " * 300000, *(r[1] for r in rows())]
    np.testing.assert_allclose(features(pa.array(texts)), [brute_features(t) for t in texts], rtol=1e-9)


def test_scores_do_not_depend_on_partitions_or_neighbours(spark):
    data, labels = corpus(300)
    data += [(1000 + i, t, "en", "s", 0, "", 0, 0) for i, t in enumerate(["one", "two words", "three little words", "one"])]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, data)
    one, many = ({r.doc_id: r.score for r in quality_scores(docs.repartition(n), table).collect()} for n in (1, 13))
    assert one == many
    assert one[1000] == one[1003]


@pytest.mark.parametrize(("share", "with_negatives"), [(0.3, True), (0.83, True), (0.83, False)])
def test_prior_is_that_of_the_unlabelled_rows(share, with_negatives):
    """Half of the labels are positive, whatever the share of positives among all rows."""
    rng = np.random.default_rng(5)
    u = rng.random(3000) < share
    y = np.concatenate((u, np.ones(400, bool), np.zeros(400, bool)))
    x = rng.normal(0, 1, (len(y), 4)) + 3 * y[:, None]
    at = np.arange(len(y))
    order = rng.permutation(len(y))
    flags = [f[order] for f in ((at >= 3000) & y, (at >= 3000) & ~y & with_negatives, at < 3000)]
    assert abs(estimated_prior(x[order], *flags) - u.mean()) < 0.04


def test_repeated_ids_and_clashing_columns_do_not_change_the_fit(spark):
    """A third of the rows has one doc_id; other columns have the names that the operator uses."""
    data, labels = corpus(300)
    docs = frame(spark, data + [(4, data[4][1] + " more", "en", "s", 0, "", 0, 0)] * 150)
    for name in ("p", "u", "x", "score", "quality", "held_out", "predicted"):
        docs = docs.withColumn(name, F.lit("7"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_scores(docs, table)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 450
    assert keep_good(docs, table).columns == docs.columns


def words_of(text):
    import re

    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def brute(docs, items, k=5, percent=80):
    out = {}
    for doc_id, text in docs:
        w = words_of(text)
        for item_id, item in items:
            i = words_of(item)
            if not i:
                continue
            if len(i) < k:
                if any(w[s : s + len(i)] == i for s in range(len(w) - len(i) + 1)):
                    out[doc_id, item_id] = 1.0
                continue
            bag = Counter(tuple(i[s : s + k]) for s in range(len(i) - k + 1))
            size, best = min(len(i), len(w)), 0
            for s in range(len(w) - size + 1):
                own = Counter(tuple(w[s + a : s + a + k]) for a in range(size - k + 1))
                both = sum((own & bag).values())
                best = max(best, both / (sum(own.values()) + sum(bag.values()) - both))
            if best * 100 >= percent:
                out[doc_id, item_id] = round(best, 6)
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(20, 50))) for i in range(12)] + [(20, "two words"), (21, None), (22, ""), (23, "!!! ---")]
    docs = [(i, prose(rng, rng.randrange(10, 120))) for i in range(30)]
    for i in range(12):
        w = items[i][1].split()
        copies = [w, [x.upper() for x in w], w[:-1], w[2:], [x + "###" for x in w], w[:10] + ["changed"] + w[11:], w[: len(w) // 2]]
        for j, c in enumerate(copies):
            docs.append((100 + 10 * i + j, " ".join([prose(rng, 30), *c, prose(rng, 30)])))
    docs += [(900, items[0][1]), (901, " ".join(items[1][1].split()[:-2])), (902, "here are Two, words!"), (903, None), (904, ""), (905, prose(rng, 20000) + " " + items[3][1]), (906, (items[4][1] + " ") * 3)]
    table = frame(spark, [(i, t, "en", "s", 0, "", 0, 0) for i, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in contaminated(table, bench).collect()}
    assert got == brute([d for d in docs if d[0] != 905], items) | {(905, 3): 1.0}
    kept = drop_contaminated(table, bench)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert contaminated(frame(spark, []), bench).count() == 0
    assert drop_contaminated(table, bench.limit(0)).count() == len(docs)


def test_hamming_blocks_miss_nothing_within_the_radius():
    rng = np.random.default_rng(3)
    items = Items([(i, prose(random.Random(i), 30)) for i in range(5)], 5, 80)
    for _ in range(300):
        flips = rng.choice(64, RADIUS, replace=False)
        i = int(rng.integers(5))
        print_ = int(items.prints[i]) ^ sum(1 << int(b) for b in flips)
        assert any(items.index[b, print_ >> 8 * b & 255, i] for b in range(8))


def test_fingerprints_are_bit_majorities():
    s = np.random.default_rng(9).integers(0, 2**63, 12).astype(np.uint64)
    got = fingerprints(s, np.array([0, 3]), 9)
    for start, value in zip((0, 3), got.tolist(), strict=True):
        for bit in range(64):
            ones = sum(int(x) >> bit & 1 for x in s[start : start + 9].tolist())
            assert (value >> bit & 1) == (2 * ones > 9)


@pytest.mark.parametrize("n", [0, 3])
def test_schema_of_helpers(spark, n):
    assert frame(spark, rows()[:n]).schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()


def test_letters_are_unicode_letters(spark):
    texts = ["² ½ 12", "١٢", "\U0001f600 _-", "ª", "中", "x"]
    data = [(1, "lorem ipsum dolor sit amet " * 5, "aa", "s", 0, "", 0, 0), *((100 + i, t, None, "s", 0, "", 0, 0) for i, t in enumerate(texts))]
    got = {r.doc_id: r.lang_pred for r in identify_language(frame(spark, data)).collect()}
    assert [got[100 + i] for i in range(6)] == ["und", "und", "und", "aa", "aa", "aa"]


def test_language_is_the_smallest_encoding(spark):
    """The prediction against plain encoding with the same dictionaries; ties and repeated rows too."""
    import zstandard

    from voxelspark.llm.language import BLOCK, LEVEL, normalise

    rng = random.Random(12)
    stems = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "ogni cosa parla della notte".split()}
    data = [(i, " ".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 300))), lang, "s", 0, "", 0, 0) for i, lang in ((i, "ab"[i % 2] * 2) for i in range(60))]
    data += [data[3], data[3], (70, "q", None, "s", 0, "", 0, 0)]
    docs = frame(spark, data)
    coders = {lang: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False) for lang, c in dictionaries(docs).items()}
    want = []
    for i, text, *_ in data:
        t = normalise(text)
        sizes = {lang: sum(len(c.compress(t[a : a + BLOCK])) for a in range(0, len(t), BLOCK)) for lang, c in coders.items()}
        want.append((i, min(sorted(sizes), key=sizes.get)))
    got = sorted((r.doc_id, r.lang_pred) for r in identify_language(docs).collect())
    assert got == sorted(want)


def test_language_ignores_clashing_columns(spark):
    docs = frame(spark, [(i, "lorem ipsum dolor " * 9, "aa", "s", 0, "", 0, 0) for i in range(8)])
    for name in ("lang_pred", "score", "held_out", "rate", "count", "r", "chunks"):
        docs = docs.withColumn(name, F.lit(3))
    got = identify_language(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "confident"] and {r.lang_pred for r in got.collect()} == {"aa"}
