"""The driver's entry points, with and without the optional subpackage."""

from __future__ import annotations

import sys

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_optional_subpackage_may_be_missing(monkeypatch):
    for name in ("quillmill.llm", "quillmill.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    found = entry.queries()
    assert "doc_profile" in found and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in found)
    assert set(entry.oracle_sql()) <= set(found)
