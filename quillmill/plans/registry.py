"""Queries by name, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# fragments of checking SQL ------------------------------------------------------


def n(body: str, col: str = "t") -> str:
    """How many characters of a class a column holds."""
    return f"len(regexp_extract_all({col}, '[{quoted(body)}]'))"


def quoted(text: str) -> str:
    return text.replace("'", "''")


def thousandths(expr: str) -> str:
    return f"floor(({expr}) * 1000 + 0.5::DOUBLE)::BIGINT"
