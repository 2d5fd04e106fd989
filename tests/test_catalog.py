"""Every query of the document engine against its SQL, on a small cut of the test tables."""

from __future__ import annotations

import io
import shutil
import zipfile

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from quillmill.plans.catalog import oracle_sql, queries
from quillmill.plans.review_queries import package_issues
from tests.oracle import check, connect

SOURCE = "/root/testdata/sf0.001"
#: Queries that may find nothing on so few rows.
MAY_BE_EMPTY = {"missing_resources", "table_grid", "caption_links", "nearest_image_match", "duplicate_ids", "low_confidence_blocks", "block_search"}


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = pq.read_table(f"{SOURCE}/documents.parquet")
    pq.write_table(docs.filter(pc.less(docs["doc_id"], 60)), folder / "documents.parquet")
    for name in ("benchmark", "events", "nation"):
        shutil.copy(f"{SOURCE}/{name}.parquet", folder)
    return str(folder)


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(name, spark, small, con):
    assert check(queries()[name], oracle_sql()[name], spark, small, con) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs(name, spark, small):
    assert queries()[name](spark, small).count() or name in MAY_BE_EMPTY


def test_corpus_has_every_kind(spark, small):
    found = {name: {r[0] for r in queries()[name](spark, small).select(column).distinct().collect()} for name, column in (("script_class", "script"), ("integrity_level", "level"), ("first_strong", "dir"), ("doc_profile", "classification"), ("furniture_kind", "kind"), ("detect_language", "lang"))}
    assert found["script_class"] == {"Arabic", "Latin", "Mixed", "Numeric", "Neutral"}
    assert {"good", "problem_likely", None} <= found["integrity_level"]
    assert found["first_strong"] == {"rtl", "ltr", None}
    assert {"native", "scanned"} <= found["doc_profile"]
    assert found["furniture_kind"] == {"header", "page_number"}
    assert {"ar", "en"} <= found["detect_language"]


def test_json_survives_the_round_trip(spark, small):
    assert all(r["n_changed"] == 0 for r in queries()["json_roundtrip"](spark, small).collect())


def test_packages_are_sound_and_damage_is_seen(spark, small):
    found = queries()["validate_package"](spark, small).groupBy("damaged", "issues").count().collect()
    assert {(r["damaged"], r["issues"]) for r in found} == {(False, ""), (True, "EPUB_UNREADABLE")}


def archive(*entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_packages_are_made_once_and_every_finding_stays(spark, small):
    plan = queries()["validate_package"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == plan.count("MapInPandas") == 1 and "Join" not in plan
    container = '<c><rootfile full-path="a/b.opf"/></c>'
    opf = '<p><item id="x" href="c.xhtml"/><item id="y" href="gone.css"/><item href="gone.css"/><itemref idref="x"/><itemref idref="z"/><itemref/></p>'
    mime = ("mimetype", "application/epub+zip")
    files = {
        1: (archive(mime, ("META-INF/container.xml", container), ("a/b.opf", opf), ("a/c.xhtml", "<html/>")), "EPUB_MANIFEST_BROKEN EPUB_MANIFEST_BROKEN EPUB_SPINE_BROKEN EPUB_SPINE_BROKEN XHTML_LANG_MISSING"),
        2: (archive(("a/c.xhtml", "<html>"), mime), "EPUB_CONTAINER_MISSING EPUB_MIMETYPE_POSITION XHTML_MALFORMED"),
        3: (archive(("mimetype", "text"), ("META-INF/container.xml", container)), "EPUB_MIMETYPE_INVALID EPUB_OPF_MISSING"),
        4: (archive(mime, ("META-INF/container.xml", "<c")), "EPUB_CONTAINER_INVALID"),
        5: (archive(mime, ("META-INF/container.xml", container), ("a/b.opf", "<p")), "EPUB_OPF_INVALID"),
        6: (archive(), ""),
        7: (b"none", "EPUB_UNREADABLE"),
    }
    rows = spark.createDataFrame([(k, False, v[0]) for k, v in files.items()], "doc_id long, damaged boolean, content binary")
    got = {k: [] for k in files}
    for r in package_issues(rows).collect():
        got[r["doc_id"]].append(r["code"])
    assert {k: " ".join(sorted(v)) for k, v in got.items()} == {k: v[1] for k, v in files.items()}


def test_low_blocks_make_their_blocks_once_and_lose_no_document(spark, small):
    from pyspark.sql import functions as F

    from quillmill.plans import structure_queries as Q

    plan = queries()["low_confidence_blocks"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == plan.count("Generate posexplode") == plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    low = Q.graded(spark, small).filter("level = 'problem_likely'").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, low.collect())) == sorted((r["doc_id"], r["n"]) for r in queries()["low_confidence_blocks"](spark, small).collect())
