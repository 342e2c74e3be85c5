import hashlib
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from voxelspark.llm.common import anti_join_few, filter_bits, join_unique
from voxelspark.llm.exact_dedup import dedup_report, exact_dedup
from voxelspark.llm.mixing import mix_sources, targets

from .helpers import SCHEMA, frame, rows


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_dedup_report_matches_brute_force(spark):
    got = dedup_report(frame(spark)).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[lower(r[1])].append(r[0])
    assert len(got) == len(rows())
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.keep_id == max((i for i in groups[text] if i is not None), default=None)
        assert r.group_size == len(groups[text])
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_exact_dedup_keeps_columns_and_one_row_a_text(spark):
    docs = frame(spark)
    got = exact_dedup(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert len(kept) == len({lower(r[1]) for r in rows()})
    assert {r.doc_id for r in kept} >= {6, 7, 8, 9, 10, 11, 22, 24, 26, None}
    assert exact_dedup(frame(spark, [])).count() == 0
    assert dedup_report(frame(spark, [])).count() == 0


def test_filter_has_a_bound_and_anti_join_is_exact(spark):
    assert filter_bits(10**12) == 1 << 26
    docs = spark.range(1000).withColumnRenamed("id", "doc_id")
    gone = spark.range(0, 1000, 7).withColumnRenamed("id", "doc_id")
    assert anti_join_few(docs, "doc_id", gone).count() == 1000 - 143


def test_join_unique_deals_a_hot_key_and_keeps_every_row(spark):
    left = spark.createDataFrame([(k, i) for i in range(300) for k in ("hot", f"cold{i % 40}")] + [("hot", 1)] * 50 + [(None, 5), ("alone", 6)], "k string, v long")
    right = left.filter("k is not null and k <> 'alone'").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"))
    for share in (0.001, 0.1, 1.0):
        for how in ("inner", "left"):
            got = join_unique(left, right, "k", "c", left.count(), how, share)
            assert got.columns == ["k", "v", "c", "s"]
            want = left.join(right, "k", how)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def water(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 30}, {None: 7, "z": 7, "é": 7, "Z": 900}, {"a": 0, "b": 5}, {"a": 5}, {f"s{i}": i * i for i in range(40)}])
def test_targets_match_iterative_resharing(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)


def test_mix_meets_targets_and_reruns_agree(spark):
    data = [(i, "w " * (1 + i * 7 % 90), "en", "hot" if i % 3 else f"s{i % 5}", 0, "", 0, 0) for i in range(4000)] + rows()
    docs = frame(spark, data)
    got = mix_sources(docs).collect()
    assert len(got) == len(data)
    assert all(0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source_size, r.target].append(r)
    for (_, target), of in by.items():
        assert abs(sum(r.taken for r in of) - target) <= max(r.size for r in of) + 1e-6
    again = mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, *r[1:])) == sorted(map(tuple, again), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
