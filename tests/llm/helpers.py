"""Fixtures with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __sha string, cid long, n int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def rows():
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(6)]
    out = [(i, base[i % 6], "en", f"s{i % 3}", None, "x", 1, 2) for i in range(12)]  # two exact copies each
    words = base[0].split()
    for i in range(12, 18):  # near copies of the first
        w = list(words)
        w[rng.randrange(len(w))] = f"new{i}"
        out.append((i, " ".join(w), "en", "s0", 5, None, None, None))
    out += [
        (20, None, None, None, None, None, None, None),
        (21, "", "en", "s1", 0, "x", 1, 2),
        (22, " \t\n", "en", "s1", 0, "x", 1, 2),
        (23, "one two", "en", "s1", 0, "x", 1, 2),
        (24, "One two", "en", "s1", 0, "x", 1, 2),
        (25, prose(rng, 30000), "en", "s2", 0, "x", 1, 2),
        (26, "ÀÉ ÀÉ straße \U0001f600", "fr", None, 0, "x", 1, 2),
        (26, "ÀÉ ÀÉ straße \U0001f600", "fr", None, 0, "x", 1, 2),
        (27, "z" * 300000, "fr", "s2", 0, "x", 1, 2),
        (None, "a text without an id", "fr", "s2", 0, "x", 1, 2),
    ]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
