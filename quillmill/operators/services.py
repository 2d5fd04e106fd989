"""Requests about blocks, resources and jobs, each decided by joins and windows over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["doc_id", "block_id"]


def check_requests(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, block_id, known, accepted`` of each block asked for; one unknown block refuses all that its document was asked for."""
    live = blocks.select(*KEY).distinct().withColumn("live", F.lit(True))
    asked = requests.select(*KEY).distinct().join(live, KEY, "left").select(*KEY, F.col("live").isNotNull().alias("known"))
    return asked.withColumn("accepted", F.bool_and("known").over(W.partitionBy("doc_id")))


def restore_collisions(blocks: DataFrame, stored: DataFrame, replaced: DataFrame) -> DataFrame:
    """``doc_id, block_id``: ids that stored blocks would bring back while another block, none of those they replace, has them."""
    stored, live, replaced = (rows.select(*KEY) for rows in (stored, blocks, replaced))
    return stored.intersect(live).subtract(replaced)


def resource_sources(refs: DataFrame, resources: DataFrame) -> DataFrame:
    """``refs`` (doc_id, resource_id) with ``src``: the file of the first such resource (by ``ord``), or the bare id if there is none."""
    first = resources.groupBy("doc_id", "resource_id").agg(F.min_by(F.struct("filename"), "ord").alias("file"))
    name = F.coalesce(F.nullif("file.filename", F.lit("")), "resource_id")
    src = F.when(F.col("file").isNull(), F.col("resource_id")).otherwise(F.concat(F.lit("resources/"), name))
    return refs.join(first, ["doc_id", "resource_id"], "left").withColumn("src", src).drop("file")


def consecutive_siblings(requested: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, consecutive``: whether the blocks asked for, in the order of ``position``, follow one another under one parent.

    blocks: ``doc_id, parent, block_id, ord``. Unknown blocks and gaps make it false; a block asked for again counts once.
    """
    siblings = W.partitionBy("doc_id", "parent").orderBy("ord")
    placed = blocks.select(*KEY, F.coalesce("parent", F.lit("")).alias("parent"), "ord").withColumn("place", F.row_number().over(siblings))
    turn = W.partitionBy("doc_id").orderBy("position")
    asked = requested.groupBy(*KEY).agg(F.min("position").alias("position"))
    rows = asked.withColumn("turn", F.row_number().over(turn)).join(placed.select(*KEY, "parent", "place"), KEY, "left")
    ahead = F.col("place") - F.col("turn")
    whole = (F.count("place") == F.count("*")) & (F.min("parent") == F.max("parent")) & (F.min(ahead) == F.max(ahead))
    return rows.groupBy("doc_id").agg(F.coalesce(whole, F.lit(False)).alias("consecutive"))


def page_blocks(blocks: DataFrame, page: Column | int) -> DataFrame:
    """Blocks of a page, those that have none included."""
    return blocks.filter(F.col("page").isNull() | (F.col("page") == page))


def replace_blocks(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """``blocks`` with those of ``new`` in the place of the same ids; what has no block to replace is left out."""
    kept = blocks.join(new.select(*KEY).distinct(), KEY, "left_anti")
    return kept.unionByName(new.join(blocks.select(*KEY).distinct(), KEY, "left_semi"))


def job_requests(log: DataFrame, starts: Column, ends: Column, document: str = "document_id", order: str = "event_id") -> DataFrame:
    """Requests for a job (rows of ``log`` where ``starts``) with ``accepted`` and ``interrupted``.

    A document has one job at a time: a request is refused unless the last thing before it was the end of a job. A
    job without an end by the end of the log was interrupted, and has failed after a restart.
    """
    rows = log.withColumn("_start", starts).withColumn("_end", ends).filter("_start or _end")
    turn = W.partitionBy(document).orderBy(order)
    rows = rows.withColumn("accepted", F.col("_start") & ~F.coalesce(F.lag("_start").over(turn), F.lit(False)))
    ended = F.max(F.when(F.col("_end"), F.col(order))).over(W.partitionBy(document))
    rows = rows.withColumn("interrupted", F.col("accepted") & (F.coalesce(ended < F.col(order), F.lit(True))))
    return rows.filter("_start").drop("_start", "_end")
