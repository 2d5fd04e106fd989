"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) whose result is written as
Parquet and read again as the next one's docs. Decisions that an operator
takes about rows return to them by a row number, since ids may repeat; each scan of a written
table numbers its rows alike, and a row that comes back with another id fails the job.

Every stage takes nulls in any column, repeated rows and ids, an empty table, and further
columns of any name, which it passes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.exact_dedup import exact_dedup
from quillmill.llm.langid import identify, train_on
from quillmill.llm.mixing import mix
from quillmill.llm.packing import pack_documents
from quillmill.llm.queries import document_quality, table, vocabulary_path
from quillmill.llm.simhash import near_duplicates
from quillmill.llm.store import materialize

#: Languages are learnt from at most about this many labelled documents of each.
MAX_DOCS_PER_LANG = 250


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number per row, and the number's column, which none of theirs is called."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def _decided(rows: DataFrame, row: str, found: DataFrame, wanted: bool) -> DataFrame:
    """The rows that are among those found, or that are not, by their number; a different id shows that two scans were numbered differently."""
    found = found.withColumnsRenamed({"row": row, "doc_id": f"{row}id"}).withColumn(f"{row}found", F.lit(True))
    same = F.col(f"{row}id").eqNullSafe(F.col("doc_id").cast("long"))
    keep = F.when(F.col(f"{row}found").isNull(), not wanted).when(same, wanted).otherwise(F.raise_error(F.lit("a row changed its number between two scans")).cast("boolean"))
    return rows.join(found, row, "left").filter(keep)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: no text, no letter in it, or a calibrated score below one half.

    If no document has a language to learn from, none can be told and none is kept.
    """
    model = train_on(docs, F.lit(True), MAX_DOCS_PER_LANG)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text").alias("text"))
    return identify(rows, model).filter("not rejected").select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, one with a null id only among such; null text equals empty text."""
    rows, row = _numbered(docs)
    gone = exact_dedup(rows, row_col=row).filter("not kept").select("row", "doc_id")
    return _decided(rows, row, gone, False).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more.

    The smallest id stays, one with a null id only among such; texts without words are near copies of one another.
    """
    rows, row = _numbered(docs)
    gone = near_duplicates(rows, row).filter("not kept").select("row", "doc_id")
    return _decided(rows, row, gone, False).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document: none, one or two. Null sources are a source; empty texts come along at no cost."""
    rows, row = _numbered(docs)
    copies = F.sequence(F.lit(1), F.col("times")).alias(f"{row}copies")
    taken = mix(rows, document_quality(), row_col=row).filter("times > 0").select("row", F.col("doc_id").cast("long").alias("doc_id"), copies)
    return _decided(rows, row, taken, True).withColumn(f"{row}copies", F.explode(f"{row}copies")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4096 tokens; null text is an empty document, one end token long."""
    return pack_documents(docs, vocabulary_path())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packing)]
#: SQL expresses neither the trained classifier nor the tokenizer; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
