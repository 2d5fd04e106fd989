"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm.store import materialize
from tests.llm.conftest import awkward
from tests.llm.test_text_ops import slow_targets

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SMALL), f"test-{name}")
        out.append(docs)
    return out


def test_columns_stay_until_the_last_stage(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_language_keeps_clean_documents(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    rows = stages[0].collect()
    assert all(any(c.isalpha() for c in r["text"] or "") for r in rows if r["doc_id"] in kept)
    assert len(kept) >= 0.98 * len(rows)


def test_exact(stages):
    before, after = stages[1].collect(), stages[2].collect()
    best: dict[str, int] = {}
    for r in before:
        key = r["text"].translate(LOWER)
        best[key] = max(best.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())


def test_near(stages):
    before, after = stages[2].collect(), {r["doc_id"] for r in stages[3].collect()}
    sets = {}
    for r in before:
        w = r["text"].translate(LOWER).split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert after == set(root.values())


def test_mixture(stages):
    before, taken = stages[3].collect(), Counter(r["doc_id"] for r in stages[4].collect())
    size = {r["doc_id"]: len(r["text"].split()) for r in before}
    source = {r["doc_id"]: r["source"] for r in before}
    total: Counter = Counter()
    for i, n in size.items():
        total[source[i]] += n
    got: Counter = Counter()
    for i, n in taken.items():
        got[source[i]] += n * size[i]
    assert max(taken.values()) <= 2
    for s, target in slow_targets(dict(total)).items():
        assert abs(got[s] - target) <= max(0.05 * target, max(n for i, n in size.items() if source[i] == s) / 2)


def test_packing_holds_every_row(stages):
    rows = stages[5].collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in stages[4].collect())


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r) for r in got.select(*key).collect()) == Counter(tuple(r) for r in stages[5].select(*key).collect())


CLASHES = ("_row", "score", "rejected", "component", "doc", "times", "bucket")


@pytest.fixture(scope="module")
def clashing(docs):
    return materialize(docs.selectExpr("*", *(f"'mine' AS {c}" for c in CLASHES)), "clashing")


def kept(spark, name, docs):
    got = materialize(dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL), f"awkward-{name}")
    if name != "packing":
        assert got.columns == docs.columns
        assert all(r[c] == "mine" for r in got.collect() for c in CLASHES if c in docs.columns)
    return got.collect()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, no_docs, name):
    assert kept(spark, name, no_docs) == []


def test_language_of_awkward_documents(spark, clashing):
    got = kept(spark, "language", clashing)
    assert all(any(c.isalpha() for c in r["text"]) for r in got)
    assert sum(r["doc_id"] is None and r["text"] is not None for r in got) == 1  # a null id goes with the rest
    assert kept(spark, "language", clashing.withColumn("lang", F.lit(None).cast("string"))) == []


def test_exact_of_awkward_documents(spark, clashing):
    best: dict[str, list] = {}
    for r in awkward():
        best.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    want = [max((i for i in ids if i is not None), default=None) for ids in best.values()]
    assert sorted(map(str, (r["doc_id"] for r in kept(spark, "exact", clashing)))) == sorted(map(str, want))


def test_near_of_awkward_documents(spark, clashing):
    ids = [r["doc_id"] for r in kept(spark, "near", clashing)]
    # 0 to 2 have no words; 3 and 4 are one letter; 9 to 13 are copies; a null id gives way
    assert sorted(ids) == [0, 3, 5, 6, 7, 8, 9, 14, 15, 16, 17, 18, 99]


def test_mixture_of_awkward_documents(spark, clashing):
    got = Counter((r["doc_id"], r["text"]) for r in kept(spark, "mixture", clashing))
    rows = Counter((r[0], r[1]) for r in awkward())
    assert all(n <= 2 * rows[k] for k, n in got.items())
    words = lambda c: sum(n * len((t or "").split()) for (_, t), n in c.items())
    assert words(rows) < words(got) <= 1.5 * words(rows)


def test_rows_numbered_differently_fail(spark, clashing):
    rows, row = corpus_pipeline._numbered(clashing)
    gone = rows.selectExpr(f"{row} AS row", "doc_id + 1 AS doc_id")
    with pytest.raises(Exception, match="changed its number"):
        corpus_pipeline._decided(rows, row, gone, False).collect()


def test_packing_of_awkward_documents(spark, clashing):
    got = Counter(r["doc_id"] for r in kept(spark, "packing", clashing) if r["piece"] == 0)
    assert got == Counter(r[0] for r in awkward())
