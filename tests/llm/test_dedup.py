"""Exact, SimHash, embedding and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import string

from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import components, embedding_dedup, simhash, substring_dedup
from quillmill.llm.exact_dedup import exact_dedup
from quillmill.llm.queries import oracle_sql, queries
from quillmill.llm.store import materialize
from tests.llm.conftest import awkward, sentence
from tests.oracle import check, connect

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SMALL = "/root/testdata/sf0.001"


def roots(nodes, linked):
    """Smallest node reachable, by flooding."""
    out = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(out[a], out[b])
            if out[a] != low or out[b] != low:
                out[a] = out[b] = low
                changed = True
    return out


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup(docs, digest_all):
    groups: dict[str, list] = {}
    for r in awkward():
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    got = exact_dedup(docs, digest_all=digest_all).collect()
    assert len(got) == len(awkward())
    want = sorted(str((i, max((x for x in g if x is not None), default=None), len(g))) for g in groups.values() for i in g)
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"])) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)  # of repeated rows with one id, too, one stays
    for r in got:
        if digest_all or r["group_size"] > 1:
            assert r["text_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def test_empty_tables(no_docs, spark):
    assert exact_dedup(no_docs, digest_all=True).count() == 0
    assert exact_dedup(no_docs).count() == 0
    assert simhash.simhash_components(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs.withColumn("r", F.monotonically_increasing_id()), "r").count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert embedding_dedup.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op9_mixing"])
def test_queries_match_sql(name, spark):
    assert check(queries()[name], oracle_sql()[name], spark, SMALL, connect(SMALL)) == 200


def slow_fingerprint(text, words=3):
    parts = [w for w in (text or "").translate(LOWER).replace("\n", " ").replace("\t", " ").split(" ") if w]
    shingles = [" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs):
    rows = [r for r in awkward() if len(r[1] or "") < 10_000]
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3]
    comp = roots(range(len(rows)), pairs)
    want = []
    for k, (doc_id, fp) in enumerate(prints):
        ids = [prints[m][0] for m in comp if comp[m] == comp[k] and prints[m][0] is not None]
        want.append(str((doc_id, fp, min(ids, default=None))))
    got = simhash.simhash_components(docs.filter("text is null or length(text) < 10000")).collect()
    assert sorted(str((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"])) for r in got) == sorted(want)


@pytest.mark.parametrize("block", [2048, 3])
def test_close_links_keep_components(spark, block):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {0}
    for c in centres:
        fps.add(c)
        for _ in range(12):
            x = rng.choice(sorted(fps - {0})) if rng.random() < 0.5 else c
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 3]
    want = roots(fps, pairs)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    links = simhash.close_links(spark.createDataFrame([(signed[f],) for f in fps], "fp long"), block=block).collect()
    back = {v: k for k, v in signed.items()}
    assert all(bin(back[r["a"]] ^ back[r["b"]]).count("1") <= 3 for r in links)
    got = roots(fps, [(back[r["a"]], back[r["b"]]) for r in links])
    assert {frozenset(f for f in fps if got[f] == got[g]) for g in fps} == {frozenset(f for f in fps if want[f] == want[g]) for g in fps}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (5, None)]
    links += [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None]
    assert got == roots({x for pair in real for x in pair}, real)


@pytest.mark.parametrize("at_once", [400, 10])
def test_components_of_few_links(spark, at_once):
    rng = random.Random(3)
    links = [(k + 1, k) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (900, 900), (None, 3), (5, None)]
    links += [(-2000 + rng.randrange(80), -2000 + rng.randrange(80)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), at_once=at_once).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None]
    assert got == roots({x for pair in real for x in pair}, real)


def test_near_copies_take_few_jobs(spark):
    """Each leaves its plan in the driver."""
    last = lambda: [spark.range(1).collect(), max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))][1]
    rng = random.Random(19)
    base = [sentence(rng, 60) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate([*base, *(f"{t} more" for t in base)])), "doc_id long, text string").withColumn("r", F.col("doc_id"))
    before = last()
    got = simhash.near_duplicates(rows, "r").collect()
    assert sum(r["kept"] for r in got) == 20
    assert last() - before < 125


def test_variants_are_not_sent_to_the_driver(spark):
    prints = materialize(spark.range(5000).select(F.xxhash64("id").alias("fp")), "fps")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "256k")  # all of it would fit, by the file's size
    plan = simhash.close_links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_duplicates_by_five_word_shingles(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(3000)]
    texts = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(400)]
        texts.append(" ".join(base))
        near = list(base)
        near[rng.randrange(400)] = "changed"
        texts.append(" ".join(near))  # similarity of about 0.975
        half = list(base[:200]) + [rng.choice(words) for _ in range(200)]
        texts.append(" ".join(half))  # about 0.33
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate([*texts, None, "", "one two", "one two"])], "r long, doc_id long, text string")
    got = {r["doc_id"]: (r["component"], r["kept"]) for r in simhash.near_duplicates(rows, "r").collect()}
    for k in range(40):
        a, b, c = (got[3 * k + j] for j in range(3))
        assert a[0] == b[0] != c[0] and (a[1], b[1], c[1]) == (True, False, True)
    assert got[120][0] == got[121][0] and got[122][0] == got[123][0]


def shingle_components(texts, words=5):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))})
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    return roots(range(len(texts)), pairs)


@pytest.mark.parametrize("block", [2048, 3])
def test_near_copies_in_large_groups(spark, block, monkeypatch):
    rng = random.Random(12)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(4000)]
    passages = [[rng.choice(words) for _ in range(30)] for _ in range(3)]
    texts = []
    for _ in range(60):  # passages that unrelated texts share, and pairs just at the limit
        own = [rng.choice(words) for _ in range(60)]
        base = [*rng.choice(passages), *own, *rng.choice(passages)]
        near = list(base)
        for k in (35, 60):
            near[k] = "changed"
        far = [*base[:30], *(rng.choice(words) for _ in range(60)), *base[-30:]]
        texts += [" ".join(x) for x in (base, near, far)]
    monkeypatch.setattr(simhash.open_pairs, "__defaults__", (block,))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("r", F.col("doc_id")).repartition(4)
    got = {r["doc_id"]: (r["component"], r["kept"]) for r in simhash.near_duplicates(rows, "r").collect()}
    want = shingle_components(texts)
    assert {i for i in got if got[i][1]} == set(want.values())
    assert len({c for c, _ in got.values()}) == len(set(want.values()))


def test_short_near_copies(spark):
    """Texts of 5 to 30 words at the limit and just below it."""
    rng = random.Random(14)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(4000)]
    texts = []
    for n in range(5, 31):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(n)]
            texts += [" ".join(base), " ".join(base[: n - max(1, (n - 4) // 5)]), " ".join(base[: n - max(1, (n - 4) // 5) - 1])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("r", F.col("doc_id"))
    got = {r["doc_id"] for r in simhash.near_duplicates(rows, "r").collect() if r["kept"]}
    assert got == set(shingle_components(texts).values())


def test_open_pairs_are_all_pairs_of_a_group(spark):
    """Members that an unrelated lead keeps apart meet one another."""
    hashes = [np.arange(100, dtype=np.uint64) + np.uint64(k) for k in range(8)]
    nodes = spark.createDataFrame([(k, 100, bytearray(simhash.sketch(h))) for k, h in enumerate(hashes)], "fp long, n long, sketch binary")
    shared = spark.createDataFrame([(7, k) for k in range(8)], "key long, fp long")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    for block in (2048, 3):
        got = {tuple(r) for r in simhash.open_pairs(shared, nodes, labels, 0.8, block).collect()}
        assert got == {(a, b) for b in range(8) for a in range(b)} - {(1, 2)}


def test_near_copies_come_from_fingerprints(spark, monkeypatch):
    """With what completes the fingerprints' pairs switched off, close copies are found and nothing else."""
    rng = random.Random(16)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(4000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(1500)]
        near = list(base)
        near[rng.randrange(1500)] = "changed"
        texts += [" ".join(base), " ".join(near), " ".join([*base[:750], *(rng.choice(words) for _ in range(750))])]
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "lead_pairs", lambda *a, **k: none)
    monkeypatch.setattr(simhash, "open_pairs", lambda *a, **k: none)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("r", F.col("doc_id"))
    gone = {r["doc_id"] for r in simhash.near_duplicates(rows, "r").collect() if not r["kept"]}
    assert all(i % 3 == 1 for i in gone) and len(gone) >= 50


def test_fingerprint_pairs_join_all_within_three_bits(spark):
    rng = random.Random(17)
    prints = [rng.getrandbits(63) for _ in range(20)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(63), 3)) for p in prints] + prints[:5]
    nodes = spark.createDataFrame(list(enumerate(prints)), "fp long, bits long")
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    got = [tuple(r) for r in simhash.fingerprint_pairs(nodes).collect()]
    assert roots(range(len(prints)), got) == roots(range(len(prints)), pairs)


def test_unlike_sets_of_one_fingerprint_lose_nothing(spark, monkeypatch):
    """All are paired with the first only, which is like none: the rest finds their copies."""
    monkeypatch.setattr(simhash, "majority_bits", lambda hashes: 5)
    rng = random.Random(18)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(4000)]
    texts = ["alone"]
    for n in range(40, 70):
        base = [rng.choice(words) for _ in range(n)]
        texts += [" ".join(base), " ".join(base[:-2]), " ".join(base[: n // 2])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("r", F.col("doc_id"))
    got = {r["doc_id"] for r in simhash.near_duplicates(rows, "r").collect() if r["kept"]}
    assert got == set(shingle_components(texts).values())


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(32)
        for _ in range(rng.integers(1, 9)):
            rows.append((centre + rng.standard_normal(32) * rng.choice([0.0, 0.05, 0.2, 0.4])).astype(np.float32).tolist())
    bad = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31]
    x = np.array(rows, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    comp = roots(range(len(x)), list(zip(*np.nonzero(linked))))
    table = spark.createDataFrame([(k, v, "x") for k, v in enumerate(rows + bad)], "vec_id long, embedding array<float>, node string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_links(table, recall=0.99999).collect()}
    want = {k: (int(linked[k].sum()), comp[k], comp[k] == k) for k in range(len(x))} | {len(x) + k: (0, len(x) + k, True) for k in range(len(bad))}
    assert got == want


def test_recall_at_production_parameters(spark):
    """Pairs just above the threshold, with the registered query's recall of 0.995."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1500, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.951 * x + math.sqrt(1 - 0.951**2) * y
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, near]))]
    found = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.filter("n_links > 0").count() >= 0.98 * len(rows)


def test_vectors_with_repeated_and_null_ids(spark):
    v, w, z = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5], [0.0, 1.0, -0.5]
    rows = [(1, v, 1), (1, v, 1), (None, v, 1), (2, w, 1), (3, z, 1), (3, None, 1), (None, None, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ball int").selectExpr("*", "'x' AS cell", "1 AS root", "2 AS k1")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_links(table, recall=0.99999).collect())
    assert got == {(1, 3, 1, True): 2, (None, 3, 1, False): 1, (2, 3, 1, False): 1, (3, 0, 3, True): 2, (None, 0, None, True): 1}


def slow_removal(texts, length):
    """texts in order; per text (removed bytes, spans, kept)."""
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = [True] * length
            seen.add(s)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most_contexts", [5000, 1])
def test_substrings(spark, most_contexts):
    rng = random.Random(9)
    shared = [sentence(rng, 12) for _ in range(6)]
    texts = [None, "", "ab" * 60, "a" * 300, "é" * 90]
    for _ in range(40):
        texts.append(" ".join(rng.choice([rng.choice(shared), sentence(rng, rng.randint(1, 9))]) for _ in range(6)))
    texts += [texts[8], texts[9] + "x", "b" + texts[10], "c" * 150 + texts[11]]
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, lo long").repartition(5)
    for length, gram in ((100, 24), (40, 12)):
        got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(table, length, gram, most_contexts=most_contexts).drop("kept_bytes").collect()}
        assert [got[k] for k in range(len(texts))] == slow_removal(texts, length)


def test_substrings_of_repeated_and_null_ids(spark):
    rng = random.Random(10)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(7, f"{a} {b}"), (7, f"{b} {a}"), (None, a), (None, c), (3, c), (3, c), (1, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(table).collect())
    size = {t: len(t) for t in (a, b, c)}
    assert sum(got.values()) == len(rows) and got[(7, 0)] == 1 and got[(1, 0)] == 1  # nulls come last, rows of one id by their place
    assert {n for i, n in got if i is None} == {size[a], size[c]} and got[(3, 0)] == got[(3, size[c])] == 1
    assert next(n for i, n in got if i == 7 and n) >= size[a] + size[b]


def test_long_texts_go_in_parts():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 2_500_000).astype(np.uint8)
    covered = np.zeros(len(data) - 99, dtype=int)
    for _, _, lo, hi in substring_dedup.text_anchors(data, 100, 24):
        for a, b in zip(lo, hi):
            covered[a : b + 1] += 1
    assert (covered == 1).all()  # each string lies in one part, under one anchor
