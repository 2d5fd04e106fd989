"""Review state of document blocks: warnings, quality issues, edits and moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmill.functions import chars as C

# Warning codes and whether they call for a review; other codes do.
CODES = {
    "SOURCE_VERIFIED": False,
    "LOW_ARABIC_CONFIDENCE": True,
    "ARABIC_RENDERED_AS_IMAGE": False,
    "AUTO_TEXT_REPAIRED": False,
    "PARAGRAPH_MERGE_UNCERTAIN": True,
    "READING_ORDER_UNCERTAIN": True,
    "FOOTNOTE_UNCERTAIN": True,
    "TABLE_FALLBACK_IMAGE": True,
    "TABLE_DETECTED": False,
    "UNISOLATED_MIXTURE": True,
    "OCR_USED": False,
    "OCR_LOW_CONFIDENCE": True,
    "FURNITURE_REMOVED": False,
    "PAGE_NUMBERS_REMOVED": False,
}
QUIET = sorted(code for code, review in CODES.items() if not review)
TEXT_TYPES = ("paragraph", "heading", "quote")


def needs_review(warnings: Column, score_milli: Column, low: Column) -> Column:
    """low: the block is in a set of poor blocks; score_milli: integrity, null if it was not scored."""
    return low | F.coalesce(score_milli < 850, F.lit(False)) | F.exists(warnings, lambda w: ~w.isin(*QUIET))


def repair_candidate(kind: Column, text: Column, modified: Column, review: Column) -> Column:
    return kind.isin(*TEXT_TYPES) & ~modified & (review | text.rlike(f"[{C.REPAIRABLE}]"))


def quality_flag(warnings: Column, confidence_milli: Column, score_milli: Column) -> Column:
    """A block that a reviewer should see; one compared with its source is not held to its extraction score."""
    unsure = ~F.array_contains(warnings, "SOURCE_VERIFIED") & (confidence_milli < 800)
    coded = F.exists(warnings, lambda w: w.rlike("UNCERTAIN|LOW_CONFIDENCE|LOW_ARABIC"))
    return F.coalesce(unsure, F.lit(False)) | F.coalesce(score_milli < 850, F.lit(False)) | coded


def resource_issues(blocks: DataFrame, resources: DataFrame) -> DataFrame:
    """``doc_id, block_id, code``: references to resources that are not there, or not usable images."""
    refs = blocks.filter("resource_id is not null").alias("b")
    joined = refs.join(resources.alias("r"), F.expr("b.doc_id = r.doc_id and b.resource_id = r.resource_id"), "left")
    code = F.when(F.col("r.resource_id").isNull(), "MISSING_RESOURCE").when(F.col("r.content").isNull() | (F.col("r.kind") != "image"), "INVALID_RESOURCE")
    return joined.select("b.doc_id", "b.block_id", code.alias("code")).filter("code is not null")


def swap_with_neighbour(blocks: DataFrame, moved: Column, down: Column, *group: str) -> DataFrame:
    """``blocks`` (ord) with ``new_ord``: moved blocks change places with a neighbour of their group; at its edge they stay."""
    order = W.partitionBy(*group).orderBy("ord")
    rows = blocks.withColumn("_step", F.when(moved, F.when(down, 1).otherwise(-1)).otherwise(0))
    prev, nxt = F.lag("_step").over(order), F.lead("_step").over(order)
    inside = (F.when(F.col("_step") == 1, F.lead("ord").over(order)).when(F.col("_step") == -1, F.lag("ord").over(order))).isNotNull()
    step = F.when((F.col("_step") != 0) & inside, F.col("_step")).when((F.col("_step") == 0) & (prev == 1), -1).when((F.col("_step") == 0) & (nxt == -1), 1).otherwise(0)
    return rows.withColumn("new_ord", F.when(step == 1, F.lead("ord").over(order)).when(step == -1, F.lag("ord").over(order)).otherwise(F.col("ord"))).drop("_step")
