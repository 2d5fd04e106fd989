"""Headings, footnotes, quotes, captions, paragraphs, lists and tables of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmill.functions import chars as C
from quillmill.functions import text as T
from quillmill.operators.geometry import PAGE, cluster_ids

HYPHENS = "-­"


def with_body_size(blocks: DataFrame) -> DataFrame:
    """``blocks`` and body_size: the size of the page's character in the middle, by characters in order of size."""
    page = W.partitionBy(*PAGE)
    weight = F.greatest(F.lit(1), F.length("text"))
    rows = blocks.withColumn("_upto", F.sum(weight).over(page.orderBy("size"))).withColumn("_total", F.sum(weight).over(page))
    return rows.withColumn("body_size", F.min(F.when(F.col("_upto") > F.floor(F.col("_total") / 2), F.col("size"))).over(page)).drop("_upto", "_total")


def with_reference_width(blocks: DataFrame) -> DataFrame:
    """``blocks`` and the page's page_x0, page_x1 and ref_width between them."""
    page = W.partitionBy(*PAGE)
    rows = blocks.withColumn("page_x0", F.min("x0").over(page)).withColumn("page_x1", F.max("x1").over(page))
    return rows.withColumn("ref_width", F.col("page_x1") - F.col("page_x0"))


def with_column_width(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with ref_width and gutter, null if the page has none) and own_width: the width of the blocks on a block's side of the gutter."""
    page = W.partitionBy(*PAGE)

    def wide(side: Column) -> Column:
        width = F.max(F.when(side, F.col("x1"))).over(page) - F.min(F.when(side, F.col("x0"))).over(page)
        return F.when(width > 0, width).otherwise(F.col("ref_width"))

    left, right = F.col("x1") < F.col("gutter"), F.col("x0") > F.col("gutter")
    return blocks.withColumn("own_width", F.when(left, wide(left)).when(right, wide(right)).otherwise(F.col("ref_width")))


def with_headings(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with body_size) and level (null if it is no heading), signals and heading_confidence."""
    rows = blocks.withColumn("clean", T.collapse_ws(F.col("text")))
    ratio = F.when(F.col("body_size") > 0, F.col("size") / F.col("body_size")).otherwise(1.0)
    signals = F.when(ratio >= 1.15, 2).otherwise(0) + F.when(F.col("flags").bitwiseAND(16) != 0, 1).otherwise(0) + F.when(F.col("clean").rlike(C.NUMBERING), 2).otherwise(0)
    first = F.col("clean").rlike(rf"(?i)^bab[{C.WS}]+[^{C.WS}]")
    level = F.when((ratio >= 1.5) | first, 1).when(ratio >= 1.25, 2).otherwise(3)
    rows = rows.withColumn("signals", signals)
    fits = (F.col("clean") != "") & (F.length("clean") <= 90) & ~T.ends_terminal(F.col("clean")) & (F.col("signals") >= 2)
    return rows.withColumn("level", F.when(fits, level)).withColumn("heading_confidence", F.least(F.lit(0.9), F.lit(0.5) + F.col("signals") * 0.1))


def footnote_marker(height: float) -> Column:
    """The marker of a block (with body_size and clean) that looks like a footnote, else null."""
    marker = F.regexp_extract("clean", C.FOOTNOTE_MARKER, 1)
    small = (F.col("body_size") > 0) & (F.col("size") <= F.col("body_size") * 0.98)
    return F.when(small & (F.col("y0") >= height * 0.75) & (F.length("clean") <= 400) & (marker != ""), marker)


def caption_like(text: Column, size: Column, body: Column) -> Column:
    stripped = T.strip_ws(text)
    return (F.length(stripped) <= 200) & (F.lower(stripped).rlike(C.CAPTION_WORDS) | ((body > 0) & (size <= body * 0.98) & (F.length(stripped) <= 80)))


def image_captions(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, page, idx, block_no``: the first block, in block order, that lies just below an image and reads like a caption."""
    pairs = images.alias("i").join(blocks.alias("b"), PAGE)
    near = F.expr("b.y0 >= i.y1 - 2 and b.y0 <= i.y1 + 40")
    wide = F.expr("(least(i.x1, b.x1) - greatest(i.x0, b.x0)) / greatest(1.0D, i.x1 - i.x0) >= 0.3")
    pairs = pairs.filter(near & wide & ~T.is_blank(F.col("b.text")) & caption_like(F.col("b.text"), F.col("b.size"), F.col("b.body_size")))
    return pairs.groupBy(*PAGE, "i.idx").agg(F.min("b.block_no").alias("block_no"))


def is_quote(text: Column, x0: Column, x1: Column, page_x0: Column, page_x1: Column, ref_width: Column, plain: Column) -> Column:
    """plain: a single block of a one-column page that is no heading, footnote or caption."""
    short = (F.length(text) <= 450) & ~T.is_blank(text)
    return plain & (ref_width > 0) & short & (x0 - page_x0 >= F.greatest(F.lit(18.0), ref_width * 0.06)) & (page_x1 - x1 >= ref_width * 0.03)


def _joins(rows: DataFrame) -> DataFrame:
    """``rows`` (goes, fragment, fits, before_width) and joins: whether a block goes on with the open paragraph.

    The line before must fill 55 per cent of the width of the open paragraph's first block. Without a gutter this is one
    width for the page; with one it is carried along the page's blocks.
    """
    order = W.partitionBy(*PAGE).orderBy("ord")
    plain = F.expr("goes and (fragment or (fits and before_width >= own_width * 0.55))")
    so_far = F.collect_list(F.when(F.col("gutter").isNotNull(), F.struct("goes", "fragment", "fits", "before_width", "own_width"))).over(order)  # of one page

    def step(acc: Column, b: Column) -> Column:
        joins = b["goes"] & (b["fragment"] | (b["fits"] & (b["before_width"] >= acc["width"] * 0.55)))
        return F.struct(F.when(joins, acc["width"]).otherwise(b["own_width"]).alias("width"), joins.alias("joins"))

    start = F.struct(F.lit(0.0).alias("width"), F.lit(False).alias("joins"))
    carried = F.aggregate("_so_far", start, step, lambda acc: acc["joins"])
    return rows.withColumn("_so_far", so_far).withColumn("joins", F.when(F.col("gutter").isNull(), plain).otherwise(carried)).drop("_so_far")


def paragraph_flow(blocks: DataFrame) -> DataFrame:
    """One row per paragraph, heading or footnote.

    ``blocks``: ord, text, box, size, ref_width, page_x0, page_x1, level (of
    headings), marker (of footnotes), clean if it is known, and, if pages may have columns, gutter and own_width. Letterless
    fragments join the open paragraph as they are and leave its box alone.
    """
    if "gutter" not in blocks.columns:
        blocks = with_column_width(blocks.withColumn("gutter", F.lit(None).cast("double")))
    page = W.partitionBy(*PAGE)
    order = page.orderBy("ord")
    rows = blocks.withColumn("before_x0", F.lag("x0").over(order)).withColumn("before_x1", F.lag("x1").over(order))
    if "clean" not in rows.columns:
        rows = rows.withColumn("clean", T.collapse_ws(F.col("text")))
    rows = rows.filter("clean <> ''")
    rows = rows.withColumn("is_heading", F.col("level").isNotNull()).withColumn("solo", F.col("is_heading") | F.col("marker").isNotNull())
    same_column = ~((F.col("x0") > F.col("before_x1") + 20) | (F.col("before_x0") > F.col("x1") + 20))
    fits = same_column & (F.abs(F.col("size") - F.lag("size").over(order)) <= 1.0) & ~T.ends_terminal(F.lag(F.substring("clean", -1, 1)).over(order))
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("before_width", F.coalesce(F.greatest(F.lit(0.0), F.lag(F.col("x1") - F.col("x0")).over(order)), F.lit(0.0)))
    rows = rows.withColumn("fragment", ~T.has_class(F.col("clean"), C.JAVA_AL + C.JAVA_LA))
    rows = rows.withColumn("goes", ~F.col("solo") & ~F.coalesce(F.lag("solo").over(order), F.lit(True))).withColumn("before_clean", F.lag("clean").over(order))
    rows = _joins(rows)
    glue = F.when(F.col("fragment") | T.starts_no_space(F.col("clean")) | F.col("before_clean").rlike(f"[{HYPHENS}]$"), "").otherwise(" ")
    rows = rows.withColumn("piece", F.when(F.col("joins"), F.concat(glue, F.col("clean"))).otherwise(F.col("clean")))
    rows = rows.withColumn("para", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = ~F.col("joins") | ~F.col("fragment")
    merged = F.count_if(F.col("joins") & ~F.col("fragment"))
    out = rows.groupBy(*PAGE, "para").agg(
        F.count("*").alias("n_blocks"),
        merged.alias("n_merged"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda s: s["piece"]), "").alias("text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_no"))), lambda s: s["block_no"].cast("string")), ",").alias("block_numbers"),
        F.min(F.when(whole, F.col("x0"))).alias("x0"),
        F.min_by("y0", "ord").alias("y0"),
        F.max(F.when(whole, F.col("x1"))).alias("x1"),
        F.max_by("y1", F.when(whole, F.col("ord"))).alias("y1"),
        F.bool_or("is_heading").alias("is_heading"),
        F.max("marker").alias("marker"),
        F.max("level").alias("level"),
        F.min("ord").alias("ord"),
        F.first("ref_width").alias("ref_width"),
        F.first("page_x0").alias("page_x0"),
        F.first("page_x1").alias("page_x1"),
        F.first("gutter").alias("gutter"),
    )
    confidence = F.when(F.col("marker").isNotNull(), 0.7).when(F.col("n_merged") > 0, 0.75).otherwise(0.95)
    return out.withColumn("confidence", confidence)


def list_runs(drafts: DataFrame) -> DataFrame:
    """``drafts`` (doc_id, page, para, text, is_heading, marker) that belong to lists, with run, item and list_marker.

    A stretch is a sequence of drafts that have a list marker or go on in lower case
    after an open one; a list is a stretch from its first marker on, if it has two drafts.
    """
    page = W.partitionBy(*PAGE)
    order = page.orderBy("para")
    rows = drafts.withColumn("list_marker", F.when(~F.col("is_heading") & F.col("marker").isNull(), F.regexp_extract("text", C.LIST_MARKER, 0)).otherwise(""))
    goes_on = ~F.col("is_heading") & F.col("marker").isNull() & F.col("text").rlike(r"^\p{Ll}") & ~T.ends_terminal(F.coalesce(F.lag("text").over(order), F.lit(".")))
    rows = rows.withColumn("has", F.col("list_marker") != "")
    rows = rows.withColumn("stretch", F.sum(F.when(F.col("has") | goes_on, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("member", F.col("has") | goes_on)
    rows = rows.filter("member")
    run = W.partitionBy(*PAGE, "stretch")
    rows = rows.withColumn("first", F.min(F.when(F.col("has"), F.col("para"))).over(run)).filter("para >= first")
    rows = rows.withColumn("n", F.count("*").over(run)).filter("n >= 2")
    rows = rows.withColumn("item", F.sum(F.when(F.col("has"), 1).otherwise(0)).over(run.orderBy("para").rowsBetween(W.unboundedPreceding, 0)))
    numbered = F.count_if(F.col("list_marker").rlike(C.ORDERED_MARKER)).over(run)
    return rows.withColumn("ordered", numbered * 2 > F.col("n")).withColumnRenamed("first", "run").drop("has", "stretch", "member")


def cell_like(lines: Column) -> Column:
    """A block of one to six lines, none blank or over 80 characters."""
    return F.size(lines).between(1, 6) & F.forall(lines, lambda x: ~T.is_blank(x["text"]) & (F.length(x["text"]) <= 80))


def rule_support(regions: DataFrame, rules: DataFrame) -> DataFrame:
    """``regions`` (doc_id, page, box) framed by a rule of the page: a range semi-join."""
    inside_h = "r.y0 >= g.y0 - 3 and r.y1 <= g.y1 + 3 and least(r.x1, g.x1 + 3) - greatest(r.x0, g.x0 - 3) >= 0.6D * (g.x1 - g.x0)"
    inside_v = "r.x0 >= g.x0 - 3 and r.x1 <= g.x1 + 3 and least(r.y1, g.y1 + 3) - greatest(r.y0, g.y0 - 3) >= 0.6D * (g.y1 - g.y0)"
    on = f"g.doc_id = r.doc_id and g.page = r.page and g.x1 > g.x0 and g.y1 > g.y0 and (({inside_h}) or ({inside_v}))"
    return regions.alias("g").join(rules.alias("r"), F.expr(on), "left_semi")


def _lines_up(cells: DataFrame, axis: str, name: str) -> DataFrame:
    """``doc_id, page, block_no, line_no`` and the number of the column or row of each cell that shares one with another."""
    pages = cells.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(axis, "block_no", "line_no"))).alias("c"))  # one page's
    pages = pages.withColumn("ids", cluster_ids(F.transform("c", lambda s: s[axis]), 6.0))
    rows = pages.select(*PAGE, F.explode(F.arrays_zip("c", "ids")).alias("z")).select(*PAGE, "z.c.block_no", "z.c.line_no", F.col("z.ids").alias("id"))
    shared = rows.withColumn("n", F.count("*").over(W.partitionBy(*PAGE, "id"))).filter("n >= 2")
    return shared.select(*PAGE, "block_no", "line_no", (F.dense_rank().over(W.partitionBy(*PAGE).orderBy("id")) - 1).cast("int").alias(name))


def tables(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """``doc_id, page, row, col, block_no, text, confidence``: cells of ruled grids. lines: doc_id, page, block_no, line_no, text, box, of cell-like blocks.

    Cells line up in columns by x0 and in rows by y0; cells that are alone in either, or that span the grid, are left out. A grid has four cells, two rows
    and two columns at least, no place twice, 60 per cent of its places filled, and a rule.
    """
    page, cell = W.partitionBy(*PAGE), [*PAGE, "block_no", "line_no"]
    rows = lines.join(_lines_up(lines, "x0", "col"), cell).join(_lines_up(lines, "y0", "row"), cell)
    rows = rows.withColumn("wide", F.max("x1").over(page) - F.min("x0").over(page)).filter("x1 - x0 <= 0.85 * wide")
    rows = rows.withColumn("n", F.count("*").over(page)).withColumn("at_place", F.count("*").over(W.partitionBy(*PAGE, "row", "col")))
    rows = rows.withColumn("n_rows", F.max("row").over(page) + 1).withColumn("n_cols", F.max("col").over(page) + 1).withColumn("twice", F.max("at_place").over(page) > 1)
    rows = rows.withColumn("fill", F.col("n") / (F.col("n_rows") * F.col("n_cols"))).filter("n >= 4 and not twice and n_rows >= 2 and n_cols >= 2 and fill >= 0.6")
    box = rows.groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    confidence = F.round(F.least(F.lit(0.9), F.col("fill") * 0.9 + 0.1), 3)
    return rows.join(rule_support(box, rules).select(*PAGE), PAGE).select(*PAGE, "row", "col", "block_no", "text", confidence.alias("confidence"))
