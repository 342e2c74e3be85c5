import hashlib
import os
import random
from collections import defaultdict

import pytest

from voxelspark.llm.chat import ESCAPE, INST, format_chat, read_chat
from voxelspark.llm.warc import members, parse, read_warc, round_trip, write_warc

SAYS = "</s>[INST] ok [/INST]"


@pytest.mark.parametrize("text", ["", SAYS, ESCAPE, ESCAPE * 3 + "[INST]", "[" + ESCAPE + "INST]", "[[INST]INST]", "<s" + ESCAPE + ">", "a[/SYS]\nb[NAME]", "plain é😀"])
def test_escaping_is_reversible_and_hides_control_strings(text):
    escaped = INST.escape(text)
    assert INST.unescape(escaped) == text
    assert not any(c in escaped for c in INST.control)


def test_chat_round_trip(spark):
    rows = [
        (-1, 0, "user", SAYS), (-1, 1, "assistant", SAYS), (1, 0, "system", "be kind"), (1, 1, "user", "hi" + ESCAPE), (1, 2, "assistant", ""), (1, 3, "user", "more"), (1, 4, "assistant", "done [NAME]"),
        (2, 0, "assistant", "first"), (2, 1, "assistant", "again"), (3, 0, "user", None), (3, 1, None, "who"), (3, 2, "[INST]", "odd role"), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a"), (None, 0, "user", "x"), (None, None, "assistant", "y"),
        *((5, i, ("user", "assistant")[i % 2], f"t{i} " + "w" * (i % 7)) for i in range(3000)), (6, 0, "user", "v" * 500000), (6, 1, "assistant", "z" * 500000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in read_chat(format_chat(df.repartition(3))).collect()}
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == turns.keys()
    for c, of in turns.items():
        of.sort()
        said = "".join(x for *_, r, x in of if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(of), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for *_, a, x in of).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars >= sum(len(x) for *_, x in of)
    assert {c: r.valid for c, r in got.items()} == {-1: True, 1: True, 2: False, 3: False, 4: False, None: False, 5: True, 6: True}
    assert read_chat(format_chat(df.limit(0))).count() == 0
    loss = format_chat(df).where("loss and conv_id = 1").orderBy("seq").collect()
    assert [INST.unescape(r.text) for r in loss] == ["", "done [NAME]"]


PAGES = "page_id long, url string, html string, block long, shard string"


def pages(spark):
    big, other = "<p>" + "é" * 600 + "</p>", "y" * 5000
    rows = [(1, "http://a/1", big, 0, ""), (2, "http://a/2", big, 0, ""), (9, None, big, 0, ""), (3, "u", "small", 0, ""), (4, "u\r\nX: 1", "small", 0, ""), (5, "u", None, 0, ""), (6, "u", "", 0, ""), (7, "u", other, 0, ""), (7, "u", other, 0, ""), (None, "u", "no id", 0, ""), (10**12, "u", "x" * 400000, 0, "")]
    return spark.createDataFrame(rows, PAGES), rows


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    got = sorted(round_trip(df).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert len(got) == len(rows)
    top = {}
    for p, _, h, *_ in rows:
        data = (h or "").encode()
        top[data] = max(top.get(data, -1), -1 if p is None else p)
    by = {(r.page_id, r.payload_digest): r for r in got}
    for p, _, h, *_ in rows:
        data = (h or "").encode()
        r = by[p, hashlib.sha1(data).hexdigest()]
        assert r.payload_bytes == len(data)
        if p != 7:
            again = len(data) >= 1000 and p != top[data]
            assert (r.record_type, r.refers_to) == (("revisit", top[data]) if again else ("response", None))
    assert sorted(r.record_type for r in got if r.page_id == 7) == ["response", "revisit"]
    assert round_trip(df.limit(0)).count() == 0


def test_payloads_without_any_id_are_kept(spark):
    alone, shared, single = "a" * 2000, "b" * 2000, "c" * 2000
    rows = [(None, f"u{i}", alone, 0, "") for i in range(3)] + [(None, "u", shared, 0, ""), (5, "u", shared, 0, ""), (None, "u", single, 0, "")]
    got = round_trip(spark.createDataFrame(rows, PAGES)).collect()
    of = lambda html: sorted((r.record_type, r.page_id, r.refers_to) for r in got if r.payload_digest == hashlib.sha1(html.encode()).hexdigest())
    assert of(alone) == [("response", None, None), ("revisit", None, None), ("revisit", None, None)]
    assert of(shared) == [("response", 5, None), ("revisit", None, 5)]
    assert of(single) == [("response", None, None)]


def test_writing_is_deterministic_rolls_and_leaves_no_temporary_files(spark, tmp_path):
    df, _ = pages(spark)
    names = []
    for i, frame in enumerate((df, df.repartition(5))):
        root = f"file://{tmp_path}/w{i}"
        manifest = write_warc(frame, root, shard_bytes=3000, roll_bytes=300)
        names.append(sorted(map(tuple, manifest.collect())))
        files = {f for f in os.listdir(f"{tmp_path}/w{i}") if f != "manifest"}
        assert files == {r[0] for r in names[-1]}
        for name, *_, records, size, sha in names[-1]:
            data = open(f"{tmp_path}/w{i}/{name}", "rb").read()
            assert len(data) == size and hashlib.sha256(data).hexdigest() == sha
            with open(f"{tmp_path}/w{i}/{name}", "rb") as f:
                parsed = [parse(m)[0] for m in members(f)]
            assert parsed[0]["WARC-Type"] == "warcinfo" and len(parsed) == records + 1
    assert names[0] == names[1] and len(names[0]) > 3
    victim = f"{tmp_path}/w0/{names[0][0][0]}"
    data = open(victim, "rb").read()
    open(victim, "wb").write(data[:-5])
    with pytest.raises(Exception, match="ends inside|incomplete|invalid"):
        read_warc(spark.read.parquet(f"{tmp_path}/w0/manifest"), f"file://{tmp_path}/w0").count()


def test_pipeline_stages_take_effect(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from .helpers import prose
    from .test_text_models import corpus

    data, labels = corpus(240)
    base = next(t for i, t, *_ in data if i % 6)
    words = base.split()
    rng = random.Random(99)
    item = prose(rng, 40)
    data += [(1000, base, "en", "s", 0, "", 0, 0), (1001, base + " one more", "en", "s", 0, "", 0, 0), (1002, " ".join((prose(rng, 40), item, prose(rng, 40))), "en", "s", 0, "", 0, 0)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.createDataFrame([r[:5] for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]
    seen, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "source_mixing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    assert not any(i % 6 == 0 and i < 240 for i in seen[0])
    first = next(i for i, t, *_ in data if t == base)
    assert first not in seen[1] and 1000 in seen[1]
    assert 1000 in seen[2] and 1001 not in seen[2] and len(words) > 20
    assert 1002 in seen[2] and 1002 not in seen[3]
    assert seen[4] == seen[3]
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in result.collect()} == seen[4]


@pytest.mark.parametrize("kind", ["outlier", "cluster", "null", "one"])
def test_shards_are_even_whatever_the_ids(spark, tmp_path, kind):
    """Bytes of the largest shard against the mean, for ids that an even cut of their range would
    put into one shard."""
    rng = random.Random(3)
    ids = {"outlier": [*range(3999), 1 << 62], "cluster": [i + (0 if i % 2 else -(1 << 62)) for i in range(4000)], "null": [None] * 2000 + list(range(2000)), "one": [7] * 4000}[kind]
    pages = spark.createDataFrame([(p, f"http://x/{i}", "".join(rng.choice("abcdef") for _ in range(2000))) for i, p in enumerate(ids)], "page_id long, url string, html string")
    manifest = write_warc(pages, f"file://{tmp_path}/w", shard_bytes=1 << 20).groupBy("shard").sum("records").collect()
    counts = [r[1] for r in manifest]
    assert sum(counts) == 4000 and len(counts) >= 8
    assert max(counts) < 2 * 4000 / len(counts)
    again = write_warc(pages.repartition(7), f"file://{tmp_path}/again", shard_bytes=1 << 20)
    key = lambda m: sorted((r.file, r.sha256) for r in m.collect())
    assert key(again) == key(spark.read.parquet(f"file://{tmp_path}/w/manifest"))
