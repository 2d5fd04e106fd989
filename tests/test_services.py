"""Services over blocks, resources and jobs, against plain Python on small tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillmill.operators import services as S
from quillmill.sources import schemas

KEY = "doc_id long, block_id string"


def pairs(rows):
    return {tuple(r) for r in rows.collect()}


def test_one_unknown_block_refuses_its_document(spark):
    blocks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], KEY)
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "z")], KEY)
    assert pairs(S.check_requests(asked, blocks)) == {(1, "a", True, True), (1, "b", True, True), (2, "a", True, False), (2, "z", False, False)}
    assert not pairs(S.check_requests(asked.limit(0), blocks))


def test_replaced_ids_do_not_collide(spark):
    live = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "b")], KEY)
    stored = spark.createDataFrame([(1, "a"), (1, "b"), (1, "new"), (2, "a")], KEY)
    assert pairs(S.restore_collisions(live, stored, spark.createDataFrame([(1, "a")], KEY))) == {(1, "b")}


def test_first_resource_names_the_file(spark):
    refs = spark.createDataFrame([(1, "p"), (1, "q"), (1, "gone"), (2, "p")], "doc_id long, resource_id string")
    files = spark.createDataFrame([(1, "p", None, 0), (1, "p", "late.png", 1), (1, "q", "q.png", 0), (2, "p", "", 0)], "doc_id long, resource_id string, filename string, ord int")
    assert pairs(S.resource_sources(refs, files)) == {(1, "p", "resources/p"), (1, "q", "resources/q.png"), (1, "gone", "gone"), (2, "p", "resources/p")}


def test_consecutive_siblings_equal_a_slice(spark):
    draw = random.Random(5)
    blocks, asked, want = [], [], {}
    for doc in range(60):
        groups = {parent: [f"{parent}{k}" for k in range(draw.randint(1, 4))] for parent in ("", "x")}
        blocks += [(doc, parent or None, b, k) for parent, ids in groups.items() for k, b in enumerate(ids)]
        known = [b for ids in groups.values() for b in ids]
        start = draw.randrange(len(known))
        ids = draw.choice([known[start : start + 2], known[start : start + 3][::-1], [known[start], "gone"], [known[start]] * 2, draw.sample(known, min(2, len(known)))])
        asked += [(doc, b, k) for k, b in enumerate(ids)]
        once = list(dict.fromkeys(ids))
        want[doc] = any(group[k : k + len(once)] == once for group in groups.values() for k in range(len(group)))
    found = S.consecutive_siblings(spark.createDataFrame(asked, f"{KEY}, position int"), spark.createDataFrame(blocks, "doc_id long, parent string, block_id string, ord int"))
    assert {r["doc_id"]: r["consecutive"] for r in found.collect()} == want and set(want.values()) == {True, False}


def test_page_blocks_and_replacement(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", None)], f"{KEY}, page int")
    assert pairs(S.page_blocks(rows, 2).select("block_id")) == {("b",), ("c",)}
    new = spark.createDataFrame([(1, "b", 9), (1, "z", 9), (2, "a", 9)], f"{KEY}, page int")
    assert pairs(S.replace_blocks(rows, new)) == {(1, "a", 1), (1, "b", 9), (1, "c", None)}


def test_one_job_of_a_document_at_a_time(spark):
    draw = random.Random(7)
    log = [(f"d{draw.randrange(8)}" if draw.random() < 0.9 else None, k, draw.choice(["start", "end", "other"])) for k in range(300)]
    active, want = {}, {}
    for doc, k, kind in log:
        if kind == "start":
            want[k] = doc not in active
            active.setdefault(doc, k)
        elif kind == "end":
            active.pop(doc, None)
    found = S.job_requests(spark.createDataFrame(log, "document_id string, event_id long, kind string"), F.expr("kind = 'start'"), F.expr("kind = 'end'")).collect()
    assert {r["event_id"]: r["accepted"] for r in found} == want
    assert {r["event_id"] for r in found if r["interrupted"]} == set(active.values())


def test_schema_export_tells_when_it_is_stale(spark, tmp_path):
    path = schemas.export_schema(tmp_path / "out" / "schema.json")
    assert schemas.schema_is_current(path) and not schemas.schema_is_current(tmp_path / "none.json")
    blocks = schemas.json_schema()["$defs"]["blocks"]["properties"]
    assert blocks["warnings"] == {"type": ["array", "null"], "items": {"type": ["string", "null"]}} and blocks["level"]["type"] == ["integer", "null"]
    path.write_text(path.read_text().replace('"level"', '"depth2"'))
    assert not schemas.schema_is_current(path)
