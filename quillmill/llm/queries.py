"""The registered query of each operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.embedding_dedup import embedding_links
from quillmill.llm.exact_dedup import exact_dedup
from quillmill.llm.html_extract import main_text
from quillmill.llm.langid import identify, train_on
from quillmill.llm.licenses import scan_licenses
from quillmill.llm.mixing import mix
from quillmill.llm.packing import pack_documents
from quillmill.llm.secrets import find_secrets
from quillmill.llm.simhash import simhash_components
from quillmill.llm.substring_dedup import remove_repeats
from quillmill.llm.text import WORD

#: Name of the public vocabulary file that documents are packed with.
VOCABULARY = "word_bpe_49k.json"
#: Characters that speak against a document's quality: neither letters nor ordinary punctuation.
ODD = r"[^\p{L}\x20\x09-\x0D.,]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_bytes")


def held_out():
    """A third of the documents, by id, that language identification never learns from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_on(docs, ~held_out())
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def document_path():
    """Documents lie in a folder per source and language."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt"))
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), name)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), document_path())


def document_quality():
    """Between 0.5 and 1: 1 less half the share of odd characters."""
    length = F.greatest(F.length("text"), F.lit(1))
    return F.coalesce(1 - F.regexp_count("text", F.lit(ODD)) / length / 2, F.lit(1.0))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), document_quality())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_html_extract": op2_html_extract,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_langid": op4_langid,
        "op5_secrets": op5_secrets,
        "op6_simhash": op6_simhash,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_licenses": op8_licenses,
        "op9_mixing": op9_mixing,
        "op10_packing": op10_packing,
    }


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""

OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    pow((('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE,
      1::DOUBLE / coalesce(1::DOUBLE - len(regexp_extract_all(text, '{ODD}'))::DOUBLE / greatest(length(text), 1)::DOUBLE / 2::DOUBLE, 1::DOUBLE)) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source),
n AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS nth, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM n),
l AS (SELECT *,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT (array_agg(level ORDER BY ratio, nth) FILTER (WHERE level <= ratio))[1] AS level FROM l),
p AS (SELECT source, source_size, n_docs, least(cap, coalesce(f.level * weight, cap)) AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM p),
c AS (
  SELECT d.doc_id, d.source, d.size, d.k, e.source_size, e.n_docs, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k DESC, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
g AS (SELECT source, budget - sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS gap FROM c GROUP BY source, budget),
x AS (SELECT source, doc_id, size, row_number() OVER (PARTITION BY source ORDER BY k DESC, doc_id) AS r FROM c WHERE upto > budget AND size > 0 AND upto - size <= budget + 256.0::DOUBLE * source_size / n_docs),
fill AS (
  SELECT source, 0::BIGINT AS r, gap, NULL::BIGINT AS doc_id FROM g
  UNION ALL
  SELECT f.source, x.r, CASE WHEN x.size <= f.gap THEN f.gap - x.size ELSE f.gap END, CASE WHEN x.size <= f.gap THEN x.doc_id END
  FROM fill f JOIN x ON x.source IS NOT DISTINCT FROM f.source AND x.r = f.r + 1)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN upto <= budget OR doc_id IN (SELECT doc_id FROM fill WHERE doc_id IS NOT NULL) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op9_mixing": OP9_SQL}
