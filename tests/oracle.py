"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool) or str(type(x)).endswith("bool_'>") or str(type(x)).endswith("numpy.bool'>"):
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return repr(round(float(x), 6) + 0.0)
        return str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


def check(query, sql: str, spark, sf_dir: str, con) -> int:
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    got_rows, want_rows = rows(got), rows(want)
    assert got_rows == want_rows, (list(set(got_rows) - set(want_rows))[:2], list(set(want_rows) - set(got_rows))[:2])
    return len(got)
