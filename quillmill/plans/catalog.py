"""All queries of the document engine, with their checking SQL."""

from __future__ import annotations

from quillmill.plans import layout_queries, review_queries, service_queries, structure_queries, text_queries  # noqa: F401 - each registers its queries
from quillmill.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
