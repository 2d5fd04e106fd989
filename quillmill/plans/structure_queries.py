"""Queries that turn ordered blocks into headings, notes, quotes, paragraphs, lists, captions and tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmill.functions import chars as C
from quillmill.functions import text as T
from quillmill.operators import furniture as U
from quillmill.operators import geometry as G
from quillmill.operators import structure as S
from quillmill.plans import corpora as K
from quillmill.plans import layout_queries as L
from quillmill.plans import text_queries as X
from quillmill.plans.registry import query

H, WD = K.HEIGHT, K.WIDTH


def filled(spark, sf_dir):
    """Non-blank blocks with their page's body size."""
    return S.with_body_size(K.blocks(spark, sf_dir).filter(~T.is_blank(F.col("text"))))


BODY = f"""{L.FILLED},
sized AS (SELECT doc_id, page, size, sum(greatest(1, length(text))) AS k FROM filled GROUP BY ALL),
cumulated AS (SELECT *, sum(k) OVER (PARTITION BY doc_id, page ORDER BY size) AS upto, sum(k) OVER (PARTITION BY doc_id, page) AS total FROM sized),
body AS (SELECT doc_id, page, min(size) AS body_size FROM cumulated WHERE upto > total // 2 GROUP BY ALL),
bodied AS (SELECT f.*, body_size, {L.CLEAN} AS clean FROM filled f JOIN body USING (doc_id, page))"""
_DUCK_NUMBERING = C.NUMBERING
HEADINGS = rf"""signalled AS (SELECT *, size / body_size AS ratio, (CASE WHEN size / body_size >= 1.15::DOUBLE THEN 2 ELSE 0 END) + (CASE WHEN flags & 16 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(clean, '{_DUCK_NUMBERING}') THEN 2 ELSE 0 END) AS signals FROM bodied),
headings AS (SELECT *, CASE WHEN ratio >= 1.5 OR regexp_matches(clean, '(?i)^bab[{C.WS}]+[^{C.WS}]') THEN 1 WHEN ratio >= 1.25 THEN 2 ELSE 3 END AS level, least(9, 5 + signals) AS confidence_tenths
  FROM signalled WHERE clean <> '' AND length(clean) <= 90 AND NOT regexp_matches(clean, '[{C.TERMINAL}][{C.WS}]*\z') AND signals >= 2)"""
NOTES = f"""notes AS (SELECT *, regexp_extract(clean, '{C.FOOTNOTE_MARKER}', 1) AS marker FROM bodied WHERE y0 >= {H}::DOUBLE * 0.75::DOUBLE AND length(clean) <= 400 AND size <= body_size * 0.98::DOUBLE AND regexp_extract(clean, '{C.FOOTNOTE_MARKER}', 1) <> '')"""


@query("body_font_size", K.with_corpora(f", {BODY} SELECT doc_id, page, body_size FROM body"))
def body_font_size(spark, sf_dir):
    return filled(spark, sf_dir).groupBy(*G.PAGE).agg(F.first("body_size").alias("body_size"))


@query("reference_width", K.with_corpora(f", {L.FILLED} SELECT doc_id, page, max(x1) - min(x0) AS ref_width FROM filled GROUP BY ALL"))
def reference_width(spark, sf_dir):
    rows = K.blocks(spark, sf_dir).filter(~T.is_blank(F.col("text")))
    return S.with_reference_width(rows).groupBy(*G.PAGE).agg(F.first("ref_width").alias("ref_width"))


@query("font_stats", K.with_corpora(f", {L.FILLED} SELECT doc_id, page, max(size) AS max_size, arg_max(greatest(0::DOUBLE, x1 - x0), block_no) AS last_width FROM filled GROUP BY ALL"))
def font_stats(spark, sf_dir):
    rows = K.blocks(spark, sf_dir).filter(~T.is_blank(F.col("text")))
    return rows.groupBy(*G.PAGE).agg(F.max("size").alias("max_size"), F.max_by(F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")), "block_no").alias("last_width"))


@query("headings", K.with_corpora(f", {BODY}, {HEADINGS} SELECT doc_id, page, block_no, level, signals, confidence_tenths FROM headings"))
def headings(spark, sf_dir):
    rows = S.with_headings(filled(spark, sf_dir)).filter("level is not null")
    return rows.select(*G.PAGE, "block_no", "level", "signals", F.floor(F.col("heading_confidence") * 10 + 0.5).cast("int").alias("confidence_tenths"))


@query("footnote_candidates", K.with_corpora(f", {BODY}, {NOTES} SELECT doc_id, page, block_no, marker FROM notes"))
def footnote_candidates(spark, sf_dir):
    rows = filled(spark, sf_dir).withColumn("clean", T.collapse_ws(F.col("text")))
    return rows.select(*G.PAGE, "block_no", S.footnote_marker(H).alias("marker")).filter("marker is not null")


_STRIPPED = rf"regexp_replace(text, '\A[{C.WS}]+|[{C.WS}]+\z', '', 'g')"
CAPTION = f"(length({_STRIPPED}) <= 200 AND (regexp_matches(lower({_STRIPPED}), '{C.CAPTION_WORDS}') OR (body_size > 0 AND size <= body_size * 0.98::DOUBLE AND length({_STRIPPED}) <= 80)))"


@query("caption_like", K.with_corpora(f", {BODY} SELECT doc_id, page, block_no, {CAPTION} AS caption_like FROM bodied"))
def caption_like(spark, sf_dir):
    return filled(spark, sf_dir).select(*G.PAGE, "block_no", S.caption_like(F.col("text"), F.col("size"), F.col("body_size")).alias("caption_like"))


@query("figure_images", K.with_corpora(f", {K.IMAGES} SELECT doc_id, page, idx FROM images WHERE (x1 - x0) * (y1 - y0) / ({WD}::DOUBLE * {H}::DOUBLE) < 0.85::DOUBLE"))
def figure_images(spark, sf_dir):
    return K.images(K.blocks(spark, sf_dir)).filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (WD * H) < 0.85).select(*G.PAGE, "idx")


CAPTIONS = f"""captions AS (SELECT i.doc_id, i.page, i.idx, min(b.block_no) AS block_no FROM images i JOIN bodied b ON i.doc_id = b.doc_id AND i.page = b.page AND b.y0 >= i.y1 - 2 AND b.y0 <= i.y1 + 40
  AND (least(i.x1, b.x1) - greatest(i.x0, b.x0)) / greatest(1::DOUBLE, i.x1 - i.x0) >= 0.3::DOUBLE WHERE {CAPTION.replace('text', 'b.text').replace('body_size', 'b.body_size').replace(' size', ' b.size')} GROUP BY ALL)"""


@query("image_caption_join", K.with_corpora(f", {K.IMAGES}, {BODY}, {CAPTIONS} SELECT doc_id, page, idx, block_no FROM captions"))
def image_caption_join(spark, sf_dir):
    return S.image_captions(K.images(K.blocks(spark, sf_dir)), filled(spark, sf_dir))


# paragraphs: all blocks but furniture, in reading order -----------------------------------


def flow_blocks(spark, sf_dir, docs=None):
    """Blocks of ``docs`` (all documents) without furniture in reading order, by columns where a page has them, with what paragraph building asks for.

    Documents are dealt out once, before blocks are made of them; every window after that stays inside a document.
    """
    docs = (K.table(spark, sf_dir, "documents") if docs is None else docs).select("doc_id", "text").repartition("doc_id")
    content = U.without_furniture(K.blocks(spark, sf_dir, docs), H)
    rows = G.in_order(G.with_gutters(content, WD)).drop("gutters", "rtl", "by_column", "confidence")
    rows = S.with_column_width(S.with_headings(S.with_reference_width(S.with_body_size(rows))))
    return rows.withColumn("marker", F.when(F.col("level").isNull(), S.footnote_marker(H)))


def paragraphs(spark, sf_dir, docs=None):
    return S.paragraph_flow(flow_blocks(spark, sf_dir, docs))


_CONTENT = "content AS (SELECT b.* FROM blocks b ANTI JOIN furniture USING (doc_id, page, block_no))"
_ORDERED = f"{L.FURNITURE}, {_CONTENT}, {L.READING.replace(' FROM blocks', ' FROM content')}, flow_filled AS (SELECT f.*, r.ord AS ro, g.gutter FROM filled f JOIN reading r USING (doc_id, page, block_no) JOIN gutters g USING (doc_id, page))"
_FLOW_BODY = BODY.replace(L.FILLED, _ORDERED).replace("FROM filled GROUP BY ALL),\ncumulated", "FROM flow_filled GROUP BY ALL),\ncumulated").replace("FROM filled f JOIN body", "FROM flow_filled f JOIN body")
LETTERS = f"regexp_matches(clean, '[{C.AL}{C.LA}]')"
_PAGE_OF = "OVER (PARTITION BY doc_id, page)"
PARAGRAPHS = rf"""{_FLOW_BODY}, {HEADINGS}, {NOTES},
widths AS (SELECT doc_id, page, max(x1) - min(x0) AS ref_width, min(x0) AS page_x0, max(x1) AS page_x1 FROM flow_filled GROUP BY ALL),
flow AS (SELECT b.*, ref_width, page_x0, page_x1, h.level, CASE WHEN h.level IS NULL THEN n.marker END AS marker, h.level IS NOT NULL OR n.marker IS NOT NULL AS solo, h.level IS NOT NULL AS is_heading,
    CASE WHEN b.x1 < b.gutter THEN coalesce(nullif(max(b.x1) FILTER (WHERE b.x1 < b.gutter) {_PAGE_OF} - min(b.x0) FILTER (WHERE b.x1 < b.gutter) {_PAGE_OF}, 0), ref_width)
      WHEN b.x0 > b.gutter THEN coalesce(nullif(max(b.x1) FILTER (WHERE b.x0 > b.gutter) {_PAGE_OF} - min(b.x0) FILTER (WHERE b.x0 > b.gutter) {_PAGE_OF}, 0), ref_width) ELSE ref_width END AS own_width FROM bodied b JOIN widths USING (doc_id, page)
  LEFT JOIN headings h USING (doc_id, page, block_no) LEFT JOIN notes n USING (doc_id, page, block_no)),
before AS (SELECT *, row_number() OVER w AS nth, lag(x0) OVER w AS bx0, lag(x1) OVER w AS bx1, lag(size) OVER w AS bsize, lag(clean) OVER w AS bclean, lag(solo) OVER w AS bsolo FROM flow WINDOW w AS (PARTITION BY doc_id, page ORDER BY ro)),
prepared AS MATERIALIZED (SELECT *, NOT {LETTERS} AS fragment, NOT solo AND NOT coalesce(bsolo, true) AS goes, coalesce(NOT (x0 > bx1 + 20 OR bx0 > x1 + 20) AND abs(size - bsize) <= 1 AND NOT regexp_matches(bclean, '[{C.TERMINAL}][{C.WS}]*\z'), false) AS fits, coalesce(bx1 - bx0, 0) AS bwidth FROM before),
walked AS (SELECT doc_id, page, nth, own_width AS open_width, false AS joins FROM prepared WHERE nth = 1
  UNION ALL SELECT doc_id, page, nth, CASE WHEN joins THEN open_width ELSE own_width END, joins
  FROM (SELECT p.doc_id, p.page, p.nth, p.own_width, w.open_width, p.goes AND (p.fragment OR (p.fits AND p.bwidth >= w.open_width * 0.55::DOUBLE)) AS joins FROM walked w JOIN prepared p ON p.doc_id = w.doc_id AND p.page = w.page AND p.nth = w.nth + 1)),
joined AS (SELECT p.*, w.joins FROM prepared p JOIN walked w USING (doc_id, page, nth)),
pieced AS (SELECT *, CASE WHEN NOT joins THEN clean WHEN fragment OR regexp_matches(clean, '\A[{C.NO_SPACE}]') OR regexp_matches(bclean, '[{S.HYPHENS}]$') THEN clean ELSE concat(' ', clean) END AS piece,
  sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY nth) AS para FROM joined),
paragraphs AS (SELECT doc_id, page, para::BIGINT AS para, count(*) AS n_blocks, count(*) FILTER (WHERE joins AND NOT fragment) AS n_merged, string_agg(piece, '' ORDER BY nth) AS text, string_agg(block_no::VARCHAR, ',' ORDER BY nth) AS block_numbers,
  min(x0) FILTER (WHERE NOT joins OR NOT fragment) AS x0, arg_min(y0, nth) AS y0, max(x1) FILTER (WHERE NOT joins OR NOT fragment) AS x1, arg_max(y1, nth) FILTER (WHERE NOT joins OR NOT fragment) AS y1,
  bool_or(is_heading) AS is_heading, max(marker) AS marker, max(level) AS level, min(ro) AS ord, min(ref_width) AS ref_width, min(page_x0) AS page_x0, min(page_x1) AS page_x1, min(gutter) AS gutter FROM pieced GROUP BY doc_id, page, para)"""


@query("paragraph_flow", K.with_corpora(f", {PARAGRAPHS} SELECT doc_id, page, para, n_blocks, n_merged, text, block_numbers, x0, y0, x1, y1, is_heading, coalesce(marker, '') AS marker FROM paragraphs"))
def paragraph_flow(spark, sf_dir):
    rows = paragraphs(spark, sf_dir).withColumn("marker", F.coalesce("marker", F.lit("")))
    return rows.select(*G.PAGE, "para", "n_blocks", "n_merged", "text", "block_numbers", "x0", "y0", "x1", "y1", "is_heading", "marker")


QUOTE = f"gutter IS NULL AND length(text) <= 450 AND regexp_matches(text, '[^{C.WS}]') AND ref_width > 0 AND x0 - page_x0 >= greatest(18::DOUBLE, ref_width * 0.06::DOUBLE) AND page_x1 - x1 >= ref_width * 0.03::DOUBLE AND n_merged = 0 AND n_blocks = 1 AND NOT is_heading AND marker IS NULL"


@query("quotes", K.with_corpora(f", {PARAGRAPHS}, {K.IMAGES}, {CAPTIONS} SELECT p.doc_id, p.page, p.para, p.text FROM paragraphs p LEFT JOIN (SELECT DISTINCT doc_id, page, block_no::VARCHAR AS block_numbers, true AS captioned FROM captions) c USING (doc_id, page, block_numbers) WHERE {QUOTE} AND captioned IS NULL"))
def quotes(spark, sf_dir):
    """Single blocks indented on both sides that are no caption."""
    return with_quotes(spark, sf_dir).filter("quote").select(*G.PAGE, "para", "text")


def with_quotes(spark, sf_dir):
    """Paragraphs and whether they are quotes."""
    captions = S.image_captions(K.images(K.blocks(spark, sf_dir)), flow_blocks(spark, sf_dir)).select(*G.PAGE, F.col("block_no").cast("string").alias("block_numbers")).distinct()
    rows = paragraphs(spark, sf_dir).join(captions.withColumn("captioned", F.lit(True)), [*G.PAGE, "block_numbers"], "left")
    plain = (F.col("n_blocks") == 1) & ~F.col("is_heading") & F.col("marker").isNull() & F.col("captioned").isNull() & F.col("gutter").isNull()
    return rows.withColumn("quote", S.is_quote(F.col("text"), F.col("x0"), F.col("x1"), F.col("page_x0"), F.col("page_x1"), F.col("ref_width"), plain))


LISTS = rf"""eligible AS (SELECT *, CASE WHEN NOT is_heading AND marker IS NULL THEN regexp_extract(text, '{C.LIST_MARKER}') ELSE '' END AS list_marker, NOT is_heading AND marker IS NULL AND regexp_matches(text, '^\p{{Ll}}')
    AND NOT regexp_matches(coalesce(lag(text) OVER (PARTITION BY doc_id, page ORDER BY para), '.'), '[{C.TERMINAL}][{C.WS}]*\z') AS goes_on FROM paragraphs),
stretched AS (SELECT *, sum(CASE WHEN list_marker <> '' OR goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY para) AS stretch FROM eligible),
members AS (SELECT *, min(CASE WHEN list_marker <> '' THEN para END) OVER (PARTITION BY doc_id, page, stretch) AS run FROM stretched WHERE list_marker <> '' OR goes_on),
runs AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, run) AS n, count(*) FILTER (WHERE regexp_matches(list_marker, '{C.ORDERED_MARKER}')) OVER (PARTITION BY doc_id, page, run) AS numbered,
  sum(CASE WHEN list_marker <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, run ORDER BY para) AS item FROM members WHERE para >= run),
lists AS (SELECT *, numbered * 2 > n AS ordered FROM runs WHERE n >= 2)"""


@query("list_runs", K.with_corpora(f", {PARAGRAPHS}, {LISTS} SELECT doc_id, page, run, para, item::BIGINT AS item, list_marker, ordered FROM lists"))
def list_runs(spark, sf_dir):
    return S.list_runs(paragraphs(spark, sf_dir)).select(*G.PAGE, "run", "para", "item", "list_marker", "ordered")


@query("list_items", K.with_corpora(f", {PARAGRAPHS}, {LISTS} SELECT doc_id, page, run, item::BIGINT AS item, regexp_replace(string_agg(text, '' ORDER BY para), '{C.LIST_MARKER}', '') AS text, count(*) AS n_drafts FROM lists GROUP BY doc_id, page, run, item"))
def list_items(spark, sf_dir):
    """Items with their continuations, without the marker."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda s: s["text"]), "")
    items = S.list_runs(paragraphs(spark, sf_dir)).groupBy(*G.PAGE, "run", "item").agg(text.alias("text"), F.count("*").alias("n_drafts"))
    return items.withColumn("text", F.regexp_replace("text", C.LIST_MARKER, ""))


# cells and tables ---------------------------------------------------------------------


@query("cell_like", K.with_corpora(f"SELECT doc_id, page, block_no, len(l) BETWEEN 1 AND 6 AND len(list_filter(l, lambda x: regexp_matches(x, '[^{C.WS}]') AND length(x) <= 80)) = len(l) AS cell_like FROM (SELECT doc_id, page, block_no, string_split(text, ', ') AS l FROM blocks)"))
def cell_like(spark, sf_dir):
    """Blocks as stacks of lines, here cut at commas."""
    lines = F.transform(F.split("text", ", "), lambda x: F.struct(x.alias("text")))
    return K.blocks(spark, sf_dir).select(*G.PAGE, "block_no", S.cell_like(lines).alias("cell_like"))


def table_cells(spark, sf_dir):
    """Words of blocks 1 to 3 as cells of a grid: the first three of a block make a row, since a cell is a short line by nature; in documents whose id divides by 11 one is missing."""
    rows = K.blocks(spark, sf_dir).filter("block_no between 1 and 3").select(*G.PAGE, "block_no", F.posexplode(F.slice(T.tokens(F.col("text")), 1, 3)).alias("line_no", "text"))
    rows = rows.filter("not (doc_id % 11 = 0 and block_no = 2 and line_no = 1) and length(text) <= 80")
    x0, y0 = F.lit(60.0) + F.col("line_no") * 150 + F.col("block_no") % 2, F.lit(100.0) + F.col("block_no") * 40 + F.col("line_no") % 2
    return rows.withColumns({"x0": x0, "y0": y0, "x1": x0 + 100, "y1": y0 + 20})


def table_rules(spark, sf_dir):
    """A long rule under the grid on odd pages, a short one on even pages."""
    pages = K.blocks(spark, sf_dir).select(*G.PAGE).distinct()
    return pages.selectExpr("doc_id", "page", "60.0D as x0", "139.0D as y0", "case when page % 2 = 1 then 460.0D else 160.0D end as x1", "140.0D as y1")


GRID = f"""cells AS (SELECT *, 60::DOUBLE + line_no * 150 + block_no % 2 AS x0, 100::DOUBLE + block_no * 40 + line_no % 2 AS y0 FROM (SELECT doc_id, page, block_no, generate_subscripts(w, 1) - 1 AS line_no, unnest(w) AS text
  FROM (SELECT doc_id, page, block_no, (regexp_extract_all(text, '[^{C.WS}]+'))[1:3] AS w FROM blocks WHERE block_no BETWEEN 1 AND 3)) WHERE NOT (doc_id % 11 = 0 AND block_no = 2 AND line_no = 1) AND length(text) <= 80),
regions AS (SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x0 + 100) AS x1, max(y0 + 20) AS y1 FROM cells GROUP BY ALL),
rules AS (SELECT DISTINCT doc_id, page, 60.0::DOUBLE AS rx0, 139.0::DOUBLE AS ry0, CASE WHEN page % 2 = 1 THEN 460.0::DOUBLE ELSE 160.0::DOUBLE END AS rx1, 140.0::DOUBLE AS ry1 FROM blocks),
supported AS (SELECT g.* FROM regions g SEMI JOIN rules r ON g.doc_id = r.doc_id AND g.page = r.page AND ((ry0 >= y0 - 3 AND ry1 <= y1 + 3 AND least(rx1, x1 + 3) - greatest(rx0, x0 - 3) >= 0.6::DOUBLE * (x1 - x0)) OR (rx0 >= x0 - 3 AND rx1 <= x1 + 3 AND least(ry1, y1 + 3) - greatest(ry0, y0 - 3) >= 0.6::DOUBLE * (y1 - y0))))"""


@query("rule_support", K.with_corpora(f", {GRID} SELECT doc_id, page, x0, y0, x1, y1 FROM supported"))
def rule_support(spark, sf_dir):
    regions = table_cells(spark, sf_dir).groupBy(*G.PAGE).agg(*G.bbox_union())
    return S.rule_support(regions, table_rules(spark, sf_dir)).select(*G.PAGE, "x0", "y0", "x1", "y1")


@query("table_grid")
def table_grid(spark, sf_dir):
    return S.tables(table_cells(spark, sf_dir), table_rules(spark, sf_dir))


@query("table_flow_exclusion", K.with_corpora(f", {PARAGRAPHS} SELECT doc_id, page, para FROM paragraphs WHERE NOT len(list_filter(string_split(block_numbers, ','), lambda b: NOT list_contains(['3', '4'], b))) = 0 OR doc_id % 3 <> 1"))
def table_flow_exclusion(spark, sf_dir):
    """Paragraphs that are not wholly made of table blocks (here 3 and 4, in a third of the documents)."""
    rows = paragraphs(spark, sf_dir)
    outside = F.size(F.array_except(F.split("block_numbers", ","), F.array(F.lit("3"), F.lit("4")))) > 0
    return rows.filter(outside | (F.col("doc_id") % 3 != 1)).select(*G.PAGE, "para")


# joining lines ----------------------------------------------------------------------------

_PAIR = "SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN concat(a, '-') ELSE a END AS a, CASE WHEN line_no % 2 = 0 THEN lower(b) ELSE b END AS b FROM (SELECT doc_id, line_no, trim(line) AS a, trim(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no)) AS b FROM lines) WHERE length(a) > 0 AND length(b) > 0"
_TRIMMED = rf"regexp_replace(a, '[{C.WS}]+\z', '')"


@query("dehyphenate", K.with_corpora(rf"SELECT doc_id, line_no, CASE WHEN fused THEN concat(substr(a, 1, length(a) - 1), b) WHEN regexp_matches(a, '-$') OR regexp_matches(b, '\A[{C.NO_SPACE}]') OR regexp_matches(a, ' $') THEN concat(a, b) ELSE concat(a, ' ', b) END AS text, CASE WHEN fused THEN concat(a, chr(10), b) ELSE '' END AS source_text FROM (SELECT *, regexp_matches(b, '^[a-z\x{{00E0}}-\x{{024F}}]') AND regexp_matches(a, '[A-Za-z\x{{00C0}}-\x{{024F}}]-$') AS fused FROM ({_PAIR}))"))
def dehyphenate(spark, sf_dir):
    """Each line joined with the next: a Latin word cut by a hyphen is mended and its source kept."""
    rows = K.lines(spark, sf_dir).selectExpr("doc_id", "line_no", "trim(line) as a", "trim(lead(line) over (partition by doc_id order by line_no)) as b").filter("length(a) > 0 and length(b) > 0")
    rows = rows.withColumn("a", F.when(F.col("line_no") % 3 == 0, F.concat("a", F.lit("-"))).otherwise(F.col("a"))).withColumn("b", F.when(F.col("line_no") % 2 == 0, F.lower("b")).otherwise(F.col("b")))
    a, b = F.col("a"), F.col("b")
    fused = b.rlike(r"^[a-z\x{00E0}-\x{024F}]") & a.rlike(r"[A-Za-z\x{00C0}-\x{024F}]-$")
    tight = a.rlike("-$") | T.starts_no_space(b) | a.rlike(" $")
    text = F.when(fused, F.concat(F.expr("substr(a, 1, length(a) - 1)"), b)).when(tight, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))
    return rows.select("doc_id", "line_no", text.alias("text"), F.when(fused, F.concat(a, F.lit("\n"), b)).otherwise("").alias("source_text"))


# assembly ------------------------------------------------------------------------------------

BLOCKS = f"""{PARAGRAPHS}, {K.IMAGES}, {CAPTIONS},
typed AS (SELECT p.*, CASE WHEN marker IS NOT NULL THEN 'footnote' WHEN is_heading THEN 'heading' WHEN {QUOTE} AND captioned IS NULL THEN 'quote' ELSE 'paragraph' END AS type, CASE WHEN marker IS NOT NULL THEN 700 WHEN n_merged > 0 THEN 750 ELSE 950 END AS confidence_milli
  FROM paragraphs p LEFT JOIN (SELECT DISTINCT doc_id, page, block_no::VARCHAR AS block_numbers, true AS captioned FROM captions) c USING (doc_id, page, block_numbers)),
document_blocks AS (SELECT *, concat('block-', CASE WHEN seq < 1000 THEN lpad(seq::VARCHAR, 3, '0') ELSE seq::VARCHAR END) AS block_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, para) AS seq FROM typed))"""


def document_blocks(spark, sf_dir):
    """doc_id, block_id, seq, page, para, type, level, text, confidence, box: a document's blocks in order."""
    rows = with_quotes(spark, sf_dir)
    kind = F.when(F.col("marker").isNotNull(), "footnote").when(F.col("is_heading"), "heading").when(F.col("quote"), "quote").otherwise("paragraph")
    return numbered(rows.withColumn("type", kind)).drop("quote")


def numbered(rows):
    """``rows`` with seq and block_id: paragraphs by page, whatever their type."""
    rows = rows.withColumn("seq", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "para")))
    return rows.withColumn("block_id", F.format_string("block-%03d", "seq"))


@query("block_ids", K.with_corpora(f", {BLOCKS} SELECT doc_id, page, para, block_id FROM document_blocks"))
def block_ids(spark, sf_dir):
    return document_blocks(spark, sf_dir).select(*G.PAGE, "para", "block_id")


@query("document_blocks", K.with_corpora(f", {BLOCKS} SELECT doc_id, block_id, page, type, coalesce(level, 0) AS level, text, confidence_milli FROM document_blocks"))
def document_blocks_query(spark, sf_dir):
    rows = document_blocks(spark, sf_dir)
    return rows.select("doc_id", "block_id", "page", "type", F.coalesce("level", F.lit(0)).alias("level"), "text", T.thousandths(F.col("confidence")).cast("int").alias("confidence_milli"))


@query("caption_links", K.with_corpora(f", {BLOCKS} SELECT c.doc_id, c.page, c.idx, d.block_id FROM captions c LEFT JOIN (SELECT doc_id, page, block_id, unnest(string_split(block_numbers, ','))::INT AS block_no FROM document_blocks WHERE type = 'paragraph') d USING (doc_id, page, block_no)"))
def caption_links(spark, sf_dir):
    """Images to the paragraph that captions them, if the caption became one."""
    flow = flow_blocks(spark, sf_dir)
    captions = S.image_captions(K.images(K.blocks(spark, sf_dir)), flow)
    members = document_blocks(spark, sf_dir).filter("type = 'paragraph'").select(*G.PAGE, "block_id", F.explode(F.split("block_numbers", ",").cast("array<int>")).alias("block_no"))
    return captions.join(members, [*G.PAGE, "block_no"], "left").select(*G.PAGE, "idx", "block_id")


@query("toc_parent", K.with_corpora(f", {BLOCKS}, h AS (SELECT * FROM document_blocks WHERE type = 'heading') SELECT a.doc_id, a.block_id, coalesce(arg_max(b.block_id, b.seq), '') AS parent FROM (SELECT a.doc_id, a.block_id, a.level, a.seq FROM h a) a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.seq < a.seq AND b.level < a.level GROUP BY a.doc_id, a.block_id"))
def toc_parent(spark, sf_dir):
    """The heading above each heading: the last earlier one of a smaller level, as a running maximum per level."""
    heads = document_blocks(spark, sf_dir).filter("type = 'heading'").select("doc_id", "seq", "block_id", "level")
    before = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    above = [F.max(F.when(F.col("level") == k, F.struct("seq", "block_id"))).over(before) for k in (1, 2)]
    parent = F.when(F.col("level") == 1, None).when(F.col("level") == 2, above[0]).otherwise(F.greatest(*above))
    return heads.select("doc_id", "block_id", F.coalesce(parent["block_id"], F.lit("")).alias("parent"))


@query("doc_languages", K.with_corpora(f", {BLOCKS}, {X.language_cte('document_blocks', 'doc_id, seq', 'text')} SELECT doc_id, string_agg(lang, ',' ORDER BY first_seq) AS languages FROM (SELECT doc_id, lang, min(seq) AS first_seq FROM labelled WHERE lang <> 'unknown' GROUP BY ALL) GROUP BY doc_id"))
def doc_languages(spark, sf_dir):
    rows = document_blocks(spark, sf_dir).select("doc_id", "seq", T.language(F.col("text"))[0].alias("lang")).filter("lang <> 'unknown'")
    first = rows.groupBy("doc_id", "lang").agg(F.min("seq").alias("seq"))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lang"))), lambda s: s["lang"]), ",").alias("languages"))


@query("primary_language", K.with_corpora(f", {BLOCKS}, {X.language_cte('document_blocks', 'doc_id, seq', 'text')} SELECT doc_id, coalesce(arg_min(lang, CASE WHEN lang <> 'unknown' THEN seq END), 'en') AS lang, CASE WHEN coalesce(arg_min(lang, CASE WHEN lang <> 'unknown' THEN seq END), 'en') = 'ar' THEN 'rtl' ELSE 'ltr' END AS dir FROM labelled GROUP BY doc_id"))
def primary_language(spark, sf_dir):
    rows = document_blocks(spark, sf_dir).select("doc_id", "seq", T.language(F.col("text"))[0].alias("lang"))
    lang = F.coalesce(F.min_by("lang", F.when(F.col("lang") != "unknown", F.col("seq"))), F.lit("en"))
    return rows.groupBy("doc_id").agg(lang.alias("lang")).withColumn("dir", F.when(F.col("lang") == "ar", "rtl").otherwise("ltr"))


# integrity by block, page and document ------------------------------------------------------------

SCORED = f"{BLOCKS}, {X.integrity_cte('document_blocks', 'doc_id, page, seq, block_id', 'text')}, graded AS (SELECT *, {X.thousandths('score')} AS milli, {X.LEVEL} AS level_name FROM scored WHERE score IS NOT NULL)"


def graded(spark, sf_dir, docs=None):
    """Blocks of ``docs`` (all documents) with Arabic letters: score in thousandths and level."""
    rows = numbered(paragraphs(spark, sf_dir, docs)).withColumn("t", F.col("text")).filter(T.has_class(F.col("text"), C.JAVA_AL))
    return X.scored(rows, "doc_id", "page", "seq", "block_id").withColumn("milli", T.thousandths(F.col("score")))


@query("integrity_by_page", K.with_corpora(f", {SCORED} SELECT doc_id, page, count(*) AS n, sum(milli)::BIGINT AS total_milli FROM graded GROUP BY ALL"))
def integrity_by_page(spark, sf_dir):
    return graded(spark, sf_dir).groupBy(*G.PAGE).agg(F.count("*").alias("n"), F.sum("milli").alias("total_milli"))


@query("low_confidence_blocks", K.with_corpora(f", {SCORED} SELECT doc_id, string_agg(block_id, ',' ORDER BY seq) AS block_ids, count(*) AS n FROM graded WHERE level_name = 'problem_likely' GROUP BY doc_id"))
def low_confidence_blocks(spark, sf_dir):
    """Pages are built only of documents whose characters allow for so low a score; of others no block could have it."""
    docs = K.table(spark, sf_dir, "documents").filter(T.may_be_problem(K.scripted("text")))
    low = F.when(F.col("level") == "problem_likely", F.struct("seq", "block_id"))  # not as a filter, into which Spark would copy every count of the score again and again
    rows = graded(spark, sf_dir, docs).withColumn("low", low).groupBy("doc_id").agg(F.array_sort(F.collect_list("low")).alias("low"))
    return rows.filter("size(low) > 0").select("doc_id", F.array_join(F.transform("low", lambda s: s["block_id"]), ",").alias("block_ids"), F.size("low").cast("long").alias("n"))


_ISSUES = "list_filter([CASE WHEN n_forms > 0 THEN 'PRESENTATION_FORMS_DETECTED' END, CASE WHEN n_unusual > 0 THEN 'UNUSUAL_CHARACTERS' END, CASE WHEN longest >= 3 THEN 'SUSPICIOUS_SPACING' END, CASE WHEN n_orphans > 0 THEN 'COMBINING_MARK_ANOMALY' END, CASE WHEN rate >= 0.2::DOUBLE THEN 'REVERSED_ORDER_SUSPECTED' END, CASE WHEN n_jumps > 0 THEN 'BIDI_ANOMALY' END], lambda x: x IS NOT NULL)"


@query("integrity_report", K.with_corpora(f", {SCORED} SELECT doc_id, count(*) AS block_count, sum(milli)::BIGINT AS total_milli, count(*) FILTER (WHERE level_name = 'problem_likely') AS n_low, array_to_string(list_sort(list_distinct(flatten(array_agg({_ISSUES})))), ',') AS issues FROM graded GROUP BY doc_id"))
def integrity_report(spark, sf_dir):
    """A document's blocks with Arabic: how many, their scores, how many are poor, and what is wrong with them."""
    t = F.col("t")
    initial, words = T.mark_initial(t)
    issues = F.array_compact(
        F.array(
            F.when(T.count_class(t, C.PF) > 0, "PRESENTATION_FORMS_DETECTED"),
            F.when(T.unusual_letters(t) > 0, "UNUSUAL_CHARACTERS"),
            F.when(T.spacing(t)["suspicious"], "SUSPICIOUS_SPACING"),
            F.when(T.marks(t)["orphans"] > 0, "COMBINING_MARK_ANOMALY"),
            F.when((words > 0) & (initial >= words * 0.2), "REVERSED_ORDER_SUSPECTED"),
            F.when(F.size(T.punctuation_jumps(t)) > 0, "BIDI_ANOMALY"),
        )
    )
    rows = graded(spark, sf_dir).withColumn("issues", issues)
    found = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))), ",")
    return rows.groupBy("doc_id").agg(F.count("*").alias("block_count"), F.sum("milli").alias("total_milli"), F.count_if(F.col("level") == "problem_likely").alias("n_low"), found.alias("issues"))


# warnings and summaries ------------------------------------------------------------------------------

WARNINGS = f"""{BLOCKS}, {L.FURNITURE}, {L.GUTTERS},
warnings AS (SELECT doc_id, 'FOOTNOTE_UNCERTAIN' AS code, 'info' AS severity, concat('pages [', string_agg(page::VARCHAR, ', ' ORDER BY page), ']') AS message FROM (SELECT DISTINCT doc_id, page FROM document_blocks WHERE type = 'footnote') GROUP BY doc_id
  UNION ALL SELECT doc_id, 'FURNITURE_REMOVED', 'info', concat('pages [', string_agg(page::VARCHAR, ', ' ORDER BY page), ']') FROM (SELECT DISTINCT doc_id, page FROM furniture WHERE kind IN ('header', 'footer')) GROUP BY doc_id
  UNION ALL SELECT doc_id, 'PAGE_NUMBERS_REMOVED', 'info', concat(count(DISTINCT page)::VARCHAR, ' pages mapped') FROM furniture WHERE kind = 'page_number' GROUP BY doc_id
  UNION ALL SELECT doc_id, 'READING_ORDER_UNCERTAIN', 'warning', concat('page ', page::VARCHAR) FROM gutters WHERE (doc_id + page) % 5 = 0 AND gutter IS NULL)"""


def _pages(prefix: str = "pages ["):
    return F.concat(F.lit(prefix), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ", "), F.lit("]"))


def doc_warnings_rows(spark, sf_dir):
    notes = document_blocks(spark, sf_dir).filter("type = 'footnote'").groupBy("doc_id").agg(_pages().alias("message")).selectExpr("doc_id", "'FOOTNOTE_UNCERTAIN' as code", "'info' as severity", "message")
    gone = L.U.furniture(K.blocks(spark, sf_dir), H)
    bands = gone.filter("kind in ('header', 'footer')").groupBy("doc_id").agg(_pages().alias("message")).selectExpr("doc_id", "'FURNITURE_REMOVED' as code", "'info' as severity", "message")
    numbers = gone.filter("kind = 'page_number'").groupBy("doc_id").agg(F.concat(F.countDistinct("page").cast("string"), F.lit(" pages mapped")).alias("message")).selectExpr("doc_id", "'PAGE_NUMBERS_REMOVED' as code", "'info' as severity", "message")
    order = L.order_uncertain(spark, sf_dir).selectExpr("doc_id", "'READING_ORDER_UNCERTAIN' as code", "'warning' as severity", "concat('page ', cast(page as string)) as message")
    return notes.unionByName(bands).unionByName(numbers).unionByName(order)


@query("doc_warnings", K.with_corpora(f", {WARNINGS} SELECT doc_id, code, severity, message FROM warnings"))
def doc_warnings(spark, sf_dir):
    return doc_warnings_rows(spark, sf_dir)


@query("warning_counts", K.with_corpora(f", {WARNINGS} SELECT code, count(*) AS n, count(DISTINCT doc_id) AS n_docs, code IN ('FOOTNOTE_UNCERTAIN', 'READING_ORDER_UNCERTAIN') AS needs_review FROM warnings GROUP BY code"))
def warning_counts(spark, sf_dir):
    rows = doc_warnings_rows(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    return rows.withColumn("needs_review", F.col("code").isin("FOOTNOTE_UNCERTAIN", "READING_ORDER_UNCERTAIN"))


@query("convert_summary", K.with_corpora(f", {WARNINGS} SELECT doc_id, count(*) AS n_blocks, max(page) AS last_page, count(*) FILTER (WHERE type = 'heading') AS n_headings, coalesce(any_value(w.n), 0) AS n_warnings FROM document_blocks LEFT JOIN (SELECT doc_id, count(*) AS n FROM warnings GROUP BY doc_id) w USING (doc_id) GROUP BY doc_id"))
def convert_summary(spark, sf_dir):
    warned = doc_warnings_rows(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_warnings"))
    rows = document_blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.max("page").alias("last_page"), F.count_if(F.col("type") == "heading").alias("n_headings"))
    return rows.join(warned, "doc_id", "left").withColumn("n_warnings", F.coalesce("n_warnings", F.lit(0)))


@query("page_ranges", K.with_corpora(f", {BLOCKS} SELECT doc_id, concat('hlm ', string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE concat(a::VARCHAR, '–', b::VARCHAR) END, ', ' ORDER BY a)) AS pages FROM (SELECT doc_id, min(page) AS a, max(page) AS b FROM (SELECT DISTINCT doc_id, page, page - dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS island FROM document_blocks WHERE type = 'heading') GROUP BY doc_id, island) GROUP BY doc_id"))
def page_ranges(spark, sf_dir):
    """Pages with headings as ranges of consecutive numbers."""
    pages = document_blocks(spark, sf_dir).filter("type = 'heading'").select("doc_id", "page").distinct()
    islands = pages.withColumn("island", F.col("page") - F.row_number().over(W.partitionBy("doc_id").orderBy("page"))).groupBy("doc_id", "island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    part = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    rows = islands.select("doc_id", "a", part.alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "part"))), lambda s: s["part"]), ", ")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("hlm "), joined).alias("pages"))
