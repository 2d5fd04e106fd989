"""Operator 1: exact duplicates by progressive refinement.

Texts are equal when identical after lower-casing A-Z. Candidates are refined
in three steps, each over the survivors of the one before:

1. byte length (lower-casing A-Z keeps it),
2. a hash of the first ``prefix_chars`` characters,
3. SHA-256 of the whole normalised text.

Every step is a map-side combined aggregate, so a group that holds a third of
all rows moves one partial row per task. The survivors of a step are handed to the next
as a bitmap of their hashed keys, whose size is fixed; a row that it lets through by chance is
hashed in vain and then found unique. Groups return to their rows by a join that splits hot digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.skew import bitmap, join_counted, maybe_in
from quillmill.llm.store import materialize
from quillmill.llm.text import lower_ascii


def fingerprints(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digest_all: bool, row_col: str | None = None) -> DataFrame:
    """``row, doc_id, n_bytes, prefix``, and ``sha256`` if ``digest_all``, else ``norm``, the text to be hashed later."""
    norm = lower_ascii(F.col(text_col))
    return docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.octet_length(norm).cast("long").alias("n_bytes"),
        F.xxhash64(lower_ascii(F.substring(F.col(text_col), 1, prefix_chars))).alias("prefix"),
        F.sha2(norm, 256).alias("sha256") if digest_all else norm.alias("norm"),
    )


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False, row_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``, and ``row`` if ``row_col`` names a unique long.

    Of equal texts the row with the largest id stays (null ids come last; of
    rows that also share their id exactly one stays). ``text_sha256`` is null
    for texts that an earlier step has shown to be unique, unless
    ``digest_all``. Null text counts as empty; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    prints = fingerprints(docs, id_col, text_col, prefix_chars, digest_all, row_col)
    steps = materialize(prints if digest_all else prints.select("n_bytes", "prefix"), "exact-fp")
    lengths = materialize(bitmap(_repeated(steps, "n_bytes"), ["n_bytes"]), "exact-lengths")
    survivors = maybe_in(steps, lengths, ["n_bytes"], "survives").filter("survives")
    pairs = ["n_bytes", "prefix"]
    groups = materialize(bitmap(_repeated(survivors, *pairs), pairs), "exact-groups")
    rows = maybe_in(steps if digest_all else prints, groups, pairs, "survives")
    if digest_all:
        rows = rows.select("row", "doc_id", "sha256", "survives")
    else:  # only of surviving rows is the whole text hashed
        rows = materialize(rows.select("row", "doc_id", F.when(F.col("survives"), F.sha2("norm", 256)).alias("sha256"), "survives"), "exact-full")
    return _finish(rows, ["row"] if row_col else [])


def _finish(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Rows (row, doc_id, sha256, survives) with what is known of their groups; those that do not survive are unique."""
    full = rows.filter("survives").drop("survives")
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("neg_row"))).alias("best")
    groups = materialize(full.groupBy("sha256").agg(F.count("*").alias("n"), best).filter("n > 1"), "exact-digests")
    joined = join_counted(full, groups, ["sha256"])
    alone = rows.filter("not survives").select("row", "doc_id", "sha256", *(F.lit(None).cast(f.dataType).alias(f.name) for f in groups.schema if f.name != "sha256"))
    joined = joined.unionByName(alone)
    return joined.select(
        *extra,
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.col("best.neg_row") == -F.col("row")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )
