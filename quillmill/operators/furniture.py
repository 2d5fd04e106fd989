"""Running headers, footers and page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmill.functions import text as T

TOP, BOTTOM, MIN_REPEAT, MAX_WORDS = 0.15, 0.85, 2, 10


def band(y0: Column, y1: Column, height: float) -> Column:
    return F.when(y1 <= height * TOP, "header").when(y0 >= height * BOTTOM, "footer")


def _banded(blocks: DataFrame, height: float) -> DataFrame:
    """``blocks`` with the band, clean text, repetition key and printed number of candidates: short non-blank blocks in a band. Null for others."""
    clean = T.collapse_ws(F.col("text"))
    rows = blocks.withColumn("band", band(F.col("y0"), F.col("y1"), height)).withColumn("clean", F.when(F.col("band").isNotNull(), clean))
    short = (F.col("clean") != "") & (F.size(F.split("clean", " ")) <= MAX_WORDS)
    rows = rows.withColumn("clean", F.when(short, F.col("clean")))
    found = F.col("clean").isNotNull()
    return rows.withColumns({"band": F.when(found, F.col("band")), "key": F.when(found, T.repetition_key(F.col("clean"))), "printed": F.when(found, T.printed_page_number(F.col("clean")))})


def candidates(blocks: DataFrame, height: float) -> DataFrame:
    """Short non-blank blocks in a band, with their repetition key and printed number."""
    return _banded(blocks, height).filter("clean is not null")


def _kind() -> Column:
    times = F.count("*").over(W.partitionBy("doc_id", "band", "key"))
    return F.when(F.col("printed").isNotNull(), "page_number").when(times >= MIN_REPEAT, F.col("band"))


def furniture(blocks: DataFrame, height: float) -> DataFrame:
    """``doc_id, page, block_no, kind, text, printed``: what is no content. Repetition counts blocks of a document."""
    rows = candidates(blocks, height).withColumn("kind", _kind()).filter("kind is not null")
    return rows.select("doc_id", "page", "block_no", "kind", F.col("clean").alias("text"), "printed")


def without_furniture(blocks: DataFrame, height: float) -> DataFrame:
    """``blocks`` that are content. One window over a document's candidates, so that blocks are made once."""
    rows = _banded(blocks, height).withColumn("_kind", _kind()).filter("_kind is null")
    return rows.select(*blocks.columns)
