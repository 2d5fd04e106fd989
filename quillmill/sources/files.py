"""Readers and writers: uploaded files, page primitives, canonical documents and packages.

What turns a file's bytes into primitives or words is a plug-in: a function
from rows of (path, content) to rows of a table in :mod:`schemas`, run by
``mapInPandas`` on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources.schemas import TABLES

MAX_BYTES = 104_857_600
Parser = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def upload_status(content: Column, n_bytes: Column) -> Column:
    """413 too large, 415 no PDF, 200 taken."""
    return F.when(n_bytes > MAX_BYTES, 413).when(F.hex(F.substring(content, 1, 5)) != "255044462D", 415).otherwise(200)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, status, content`` of the files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", upload_status(F.col("content"), F.col("length")).alias("status"), "content")


def extract(files: DataFrame, parser: Parser, table: str) -> DataFrame:
    """Rows of ``table`` from accepted files, by a plugged-in parser."""
    return files.filter("status = 200").select("path", "content").mapInPandas(parser, TABLES[table])


def read_table(spark: SparkSession, path: str, table: str, form: str = "parquet") -> DataFrame:
    """A table under its fixed schema; JSON that does not fit it fails."""
    reader = spark.read.schema(TABLES[table])
    return reader.option("mode", "FAILFAST").json(path) if form == "json" else reader.parquet(path)


def write_table(rows: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """Written as a whole or not at all: Spark commits a job's files at its end."""
    writer = rows.write.mode(mode)
    writer.json(path) if form == "json" else writer.parquet(path)


# Recognisers by name ---------------------------------------------------------------

RECOGNIZERS: dict[str, Parser] = {}


def register(name: str) -> Callable[[Parser], Parser]:
    def add(f: Parser) -> Parser:
        RECOGNIZERS[name] = f
        return f

    return add


def recognizer(name: str) -> Parser:
    if name not in RECOGNIZERS:
        raise KeyError(f"no recogniser is named {name!r}; there are {sorted(RECOGNIZERS) or 'none'}")
    return RECOGNIZERS[name]


def recognize(files: DataFrame, name: str) -> DataFrame:
    """OCR words of accepted files, by a registered recogniser."""
    return extract(files, recognizer(name), "ocr_words")
