"""Queries of the services over blocks, resources and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import services as S
from quillmill.plans import corpora as K
from quillmill.plans.registry import query
from quillmill.plans.review_queries import canon, resources, sql

# Two blocks of its first page are asked for in each document, the second of which may not be there.
_ASKED = "array('b1-0', concat('b1-', cast(doc_id % 11 as string)))"


@query("request_check", sql("""SELECT doc_id, block_id, known, bool_and(known) OVER (PARTITION BY doc_id) AS accepted FROM (SELECT a.doc_id, a.block_id, c.block_id IS NOT NULL AS known
  FROM (SELECT DISTINCT doc_id, unnest(['b1-0', concat('b1-', (doc_id % 11)::VARCHAR)]) AS block_id FROM canon) a LEFT JOIN canon c USING (doc_id, block_id))"""))
def request_check(spark, sf_dir):
    """Blocks asked for and whether they exist; a document with an unknown one refuses the whole request."""
    rows = canon(spark, sf_dir)
    return S.check_requests(rows.select("doc_id").distinct().select("doc_id", F.explode(F.expr(_ASKED)).alias("block_id")), rows)


@query("restore_collisions", sql("""SELECT DISTINCT c.doc_id, s.block_id FROM canon c, LATERAL (SELECT unnest([concat('b', c.page::VARCHAR, '-2'), concat(CASE WHEN c.doc_id % 2 = 1 THEN 'b' ELSE 'x' END, c.page::VARCHAR, '-3')]) AS block_id) s
  WHERE c.block_no = 2 AND s.block_id <> c.block_id AND EXISTS (SELECT 1 FROM canon d WHERE d.doc_id = c.doc_id AND d.block_id = s.block_id)"""))
def restore_collisions(spark, sf_dir):
    """The third block of a page stands for two stored ones; the second of these may have the id of a block in use."""
    rows = canon(spark, sf_dir)
    shown = rows.filter("block_no = 2")
    page = F.col("page").cast("string")
    prefix = F.when(F.col("doc_id") % 2 == 1, "b").otherwise("x")
    stored = shown.select("doc_id", F.explode(F.array("block_id", F.concat(prefix, page, F.lit("-3")))).alias("block_id"))
    return S.restore_collisions(rows, stored, shown)


@query("resource_sources", sql("SELECT c.doc_id, c.block_id, CASE WHEN r.resource_id IS NULL THEN c.resource_id WHEN r.content IS NULL THEN concat('resources/', c.resource_id) ELSE concat('resources/', c.resource_id, '.png') END AS src FROM canon c LEFT JOIN resources r USING (doc_id, resource_id) WHERE c.resource_id IS NOT NULL"))
def resource_sources(spark, sf_dir):
    """Where an image block's file is, by its resource's file name, else its id."""
    refs = canon(spark, sf_dir).filter("resource_id is not null").select("doc_id", "block_id", "resource_id")
    files = resources(spark, sf_dir).selectExpr("doc_id", "resource_id", "concat(resource_id, '.', content) as filename", "0 as ord")
    return S.resource_sources(refs, files).select("doc_id", "block_id", "src")


@query("sibling_runs", sql("""SELECT d.doc_id, d.doc_id % 3 <> 0 AND count(c.block_id) = 2 AS consecutive FROM (SELECT DISTINCT doc_id FROM canon) d
  LEFT JOIN canon c ON c.doc_id = d.doc_id AND c.page = 1 AND c.block_no IN (d.doc_id % 7, d.doc_id % 7 + 1) GROUP BY d.doc_id"""))
def sibling_runs(spark, sf_dir):
    """Whether two blocks asked for are neighbours on the first page; every third document asks for the later one first."""
    rows = canon(spark, sf_dir)
    k, turned = F.col("doc_id") % 7, F.col("doc_id") % 3 == 0
    asked = rows.select("doc_id").distinct().withColumn("position", F.explode(F.array(F.lit(0), F.lit(1))))
    step = F.when(turned, 1 - F.col("position")).otherwise(F.col("position"))
    asked = asked.withColumn("block_id", F.concat(F.lit("b1-"), (k + step).cast("string")))
    return S.consecutive_siblings(asked, rows.select("doc_id", "block_id", F.col("page").cast("string").alias("parent"), "ord"))


@query("page_blocks", sql("SELECT doc_id, block_id FROM canon WHERE page = 2 OR type = 'footnote'"))
def page_blocks(spark, sf_dir):
    """Blocks of the second page, with notes, which have no page here."""
    rows = canon(spark, sf_dir).withColumn("page", F.when(F.col("type") != "footnote", F.col("page")))
    return S.page_blocks(rows, 2).select("doc_id", "block_id")


@query("replace_blocks", sql("SELECT doc_id, block_id, CASE WHEN block_no = 1 THEN concat('[', text, ']') ELSE text END AS text FROM canon"))
def replace_blocks(spark, sf_dir):
    """The second block of each page gives way to a bracketed one; a block that is not there is not replaced."""
    rows = canon(spark, sf_dir).select("doc_id", "block_id", "block_no", "text")
    new = rows.filter("block_no = 1").withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))
    stray = new.withColumn("block_id", F.concat(F.lit("none-"), "block_id"))
    return S.replace_blocks(rows, new.unionByName(stray)).select("doc_id", "block_id", "text")


_START, _END = "event_type = 'click'", "event_type = 'purchase'"


@query("job_requests", f"""WITH log AS (SELECT user_id, event_id, {_START} AS start FROM events WHERE {_START} OR {_END}),
  turns AS (SELECT *, start AND NOT coalesce(lag(start) OVER (PARTITION BY user_id ORDER BY event_id), false) AS accepted FROM log)
  SELECT user_id, event_id, accepted, accepted AND NOT EXISTS (SELECT 1 FROM log l WHERE l.user_id = t.user_id AND NOT l.start AND l.event_id > t.event_id) AS interrupted FROM turns t WHERE start""")
def job_requests(spark, sf_dir):
    """Clicks ask for a job of their user, purchases end it."""
    found = S.job_requests(K.table(spark, sf_dir, "events"), F.expr(_START), F.expr(_END), "user_id")
    return found.select("user_id", "event_id", "accepted", "interrupted")
