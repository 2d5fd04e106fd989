"""Page geometry, scripts and document blocks derived from the test tables.

Each corpus is a DataFrame; ``CTE`` holds the same derivation for the SQL that
checks the queries. Case expressions are shared text, with placeholders where
dialects differ, so that both sides read the same corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 595.0, 842.0
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# An Arabic letter, and an Arabic presentation form, for each Latin one.
ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنه"
FORMS = "".join(map(chr, (0xFE8D, 0xFE91, 0xFE97, 0xFE9B, 0xFE9F, 0xFEA3, 0xFEA7, 0xFEA9, 0xFEAB, 0xFEAD, 0xFEAF, 0xFEB3, 0xFEB7, 0xFEBB, 0xFEBF, 0xFEC3, 0xFEC7, 0xFECB, 0xFECF, 0xFED3, 0xFED7, 0xFEDB, 0xFEDF, 0xFEE3, 0xFEE7, 0xFEEB)))


def _scripted(col: str) -> str:
    """A text in one of five scripts, by the document's id."""
    return f"""case
  when doc_id % 5 = 0 then {col}
  when doc_id % 5 = 1 then translate(lower({col}), '{LOWER}', '{ARABIC}')
  when doc_id % 5 = 2 then translate({col}, '{UPPER}', '{ARABIC}')
  when doc_id % 5 = 3 then replace(replace(translate(lower({col}), '{LOWER}', '{ARABIC}'), 'ا', 'اَ'), ' ت', ' َت')
  else concat('ا ل س ل ا م ', translate(lower({col}), '{LOWER}', '{FORMS}')) end"""


_SCRIPTS = f"""case when doc_id % 50 = 7 then cast(n_chars as STR)
  when doc_id % 50 = 9 then '؟!.,؛'
  when doc_id % 50 = 19 then concat('؟ ', cast(n_chars as STR), '،', {_scripted('text')})
  when doc_id % 50 = 29 then concat({_scripted('text')}, NL, ':', NL, 'სტ')
  else {_scripted('text')} end"""

# Captions, notes and headings are short by nature: theirs are cut from a line, which stands whole in every other block.
_BLOCK_TEXT = """case when block_no = 0 then concat('Kitab ', cast(doc_id % 3 as STR))
  when block_no = 7 and doc_id % 2 = 0 then cast(page as STR)
  when block_no = 7 then concat('- ', cast(page as STR), ' -')
  when block_no = 5 and doc_id % 10 = 0 then concat('Gambar ', cast(page as STR), ': ', substr(line, 1, 40))
  when block_no = 6 then concat(cast(page as STR), '. ', substr(line, 1, 60))
  when block_no = 1 and doc_id % 3 = 0 then concat('Bab ', cast(page as STR), ': ', substr(line, 1, 30))
  when block_no in (3, 4) and doc_id % 6 = 1 then concat(cast(block_no - 2 as STR), '. ', line)
  when block_no in (3, 4) and doc_id % 6 = 2 then concat('• ', line)
  else line end"""
_X0 = "case when doc_id % 4 = 0 and block_no in (2, 4) then 310.0 when block_no = 5 then 110.0 else 50.0 end"
_X1 = "case when doc_id % 4 = 0 then x0 + 235.0 when block_no = 5 then 485.0 when block_no = 2 and doc_id % 7 = 0 then 300.0 else 535.0 end"
_Y0 = """case when block_no = 0 then 20.0 when block_no = 7 then 800.0 when block_no = 6 then 680.0
  when doc_id % 4 = 0 then 100.0 + 90.0 * ((block_no + 1) IDIV 2) else 60.0 + 90.0 * block_no end"""
_Y1 = "y0 + case when block_no in (0, 7) then 20.0 else 60.0 end"
_SIZE = "case when block_no = 0 then 18.0 when block_no = 6 then 9.0 when block_no = 1 and doc_id % 3 = 0 then 16.0 else 11.0 end"
_FLAGS = "case when block_no = 0 or (block_no = 1 and doc_id % 3 = 0) then 16 else 0 end"


def _spark(sql: str) -> str:
    return sql.replace(" as STR)", " as string)").replace("IDIV", "div").replace("NL", "'\\n'")


def _duck(sql: str) -> str:
    out = sql.replace(" as STR)", " as VARCHAR)").replace("IDIV", "//").replace("NL", "chr(10)")
    for n in ("310.0", "110.0", "50.0", "235.0", "485.0", "300.0", "535.0", "20.0", "800.0", "680.0", "100.0", "90.0", "60.0", "18.0", "9.0", "16.0", "11.0"):
        out = out.replace(f" {n}", f" {n}::DOUBLE")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t: each document's text in a script."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_spark(_SCRIPTS)} as t")


def scripted(col: str) -> Column:
    """A column of ``documents`` in the document's script; lines are made of no other characters."""
    return F.expr(_spark(_scripted(col)))


def lines(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, line_no, line: the lines of ``docs`` (all documents), in a script."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    docs = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return docs.selectExpr("doc_id", "line_no", f"{_spark(_scripted('raw'))} as line")


def blocks(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, page, block_no, text, x0, y0, x1, y1, size, flags: eight lines to a page, with page furniture; of ``docs`` (all documents)."""
    rows = lines(spark, sf_dir, docs).selectExpr("doc_id", "cast(line_no div 8 + 1 as int) as page", "cast(line_no % 8 as int) as block_no", "line")
    rows = rows.selectExpr("doc_id", "page", "block_no", f"{_spark(_BLOCK_TEXT)} as text", f"cast({_X0} as double) as x0", f"cast({_spark(_Y0)} as double) as y0", f"cast({_SIZE} as double) as size", f"{_FLAGS} as flags")
    return rows.selectExpr("doc_id", "page", "block_no", "text", "x0", "y0", f"cast({_X1} as double) as x1", f"cast({_Y1} as double) as y1", "size", "flags")


CTE = f"""scripts AS (SELECT doc_id, {_duck(_SCRIPTS)} AS t FROM documents),
lines AS (SELECT doc_id, line_no, {_duck(_scripted('raw'))} AS line
  FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
block_lines AS (SELECT doc_id, (line_no // 8 + 1)::INT AS page, (line_no % 8)::INT AS block_no, line FROM lines),
block_boxes AS (SELECT doc_id, page, block_no, {_duck(_BLOCK_TEXT)} AS text, ({_X0})::DOUBLE AS x0, ({_duck(_Y0)})::DOUBLE AS y0, ({_SIZE})::DOUBLE AS size, ({_FLAGS})::INT AS flags FROM block_lines),
blocks AS (SELECT doc_id, page, block_no, text, x0, y0, ({_X1})::DOUBLE AS x1, ({_Y1})::DOUBLE AS y1, size, flags FROM block_boxes)"""


def with_corpora(sql: str) -> str:
    """Put the corpora before a SELECT, or before further WITH items that start with a comma."""
    return f"WITH RECURSIVE {CTE}\n{sql}"


def images(page_blocks: DataFrame) -> DataFrame:
    """doc_id, page, idx, x0, y0, x1, y1: a figure above every caption candidate, and a scan on some pages."""
    figure = page_blocks.filter("block_no = 5 and doc_id % 10 = 0").selectExpr("doc_id", "page", "1 as idx", "x0 + 20 as x0", "y0 - 80 as y0", "x1 - 20 as x1", "y0 - 10 as y1")
    scan = page_blocks.filter("block_no = 0 and doc_id % 9 = 0").selectExpr("doc_id", "page", "2 as idx", "0.0D as x0", "0.0D as y0", "595.0D as x1", "cast(case when page % 2 = 0 then 842.0 else 400.0 end as double) as y1")
    return figure.unionByName(scan)


IMAGES = """images AS (SELECT doc_id, page, 1 AS idx, x0 + 20 AS x0, y0 - 80 AS y0, x1 - 20 AS x1, y0 - 10 AS y1 FROM blocks WHERE block_no = 5 AND doc_id % 10 = 0
  UNION ALL SELECT doc_id, page, 2, 0.0, 0.0, 595.0, CASE WHEN page % 2 = 0 THEN 842.0 ELSE 400.0 END FROM blocks WHERE block_no = 0 AND doc_id % 9 = 0)"""
