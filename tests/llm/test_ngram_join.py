import random

import pytest

from voxelspark.llm import ngram_join
from voxelspark.llm.components import connected_components
from voxelspark.llm.ngram_join import keep_one_of_each, ngram_jaccard_join

from .helpers import frame, prose, rows


def brute(data, k, percent):
    sets, up = {}, {}
    for doc_id, text in data:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        up[doc_id] = doc_id

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent", "cell"), [(4, 85, ngram_join.MAX_CELL), (5, 80, ngram_join.MAX_CELL), (4, 60, 16)])
def test_components_match_brute_force(spark, monkeypatch, k, percent, cell):
    monkeypatch.setattr(ngram_join, "MAX_CELL", cell)  # sixteen comparisons: every mixed block becomes a grid
    rng = random.Random(k)
    data = [r for r in rows() if r[0] is not None]
    shared = prose(rng, 60)
    for g in range(8):  # chains of near copies, around a passage that all documents share
        words = (prose(rng, 90) + " " + shared).split()
        for c in range(9):
            words[rng.randrange(90)] = f"x{g}_{c}"
            data.append((100 + 20 * g + c, " ".join(words), "en", "s", 0, "", 0, 0))
    data += [(400 + i, shared + f" tail{i}", "en", "s", 0, "", 0, 0) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, data), k, percent).collect()}
    assert got == brute([r[:2] for r in data], k, percent)


def test_long_sets_match_brute_force(spark):
    rng = random.Random(11)
    data, base = [], [prose(rng, 2600).split() for _ in range(3)]
    for i in range(18):  # from near copies to texts that share only half, around the sizes that have a long sketch
        words = list(base[i % 3][: rng.choice((2000, 2060, 2600))])
        for at in rng.sample(range(len(words)), rng.choice((5, 40, 60, 110, 600))):
            words[at] = f"y{i}"
        data.append((i, " ".join(words), "en", "s", 0, "", 0, 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, data), 5, 80).collect()}
    want = brute([r[:2] for r in data], 5, 80)
    assert got == want and 3 < len({c for _, c in want.values()}) < 18


def test_one_of_each_stays_and_columns_pass(spark):
    docs = frame(spark)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in brute([r[:2] for r in rows() if r[0] is not None], 5, 80).items() if i == c}
    assert {r.doc_id for r in kept.collect()} - {None} == want
    assert ngram_jaccard_join(frame(spark, [])).count() == 0
    assert keep_one_of_each(frame(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 3), (100, 101)]
    got = {r.cid: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
