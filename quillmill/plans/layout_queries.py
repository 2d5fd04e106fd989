"""Queries over page geometry: profiles, furniture, columns and reading order."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmill.functions import chars as C
from quillmill.functions import text as T
from quillmill.operators import furniture as U
from quillmill.operators import geometry as G
from quillmill.plans import corpora as K
from quillmill.plans.registry import n, query, thousandths

H, WD = K.HEIGHT, K.WIDTH


def blocks(spark, sf_dir):
    return K.blocks(spark, sf_dir)


CLEAN = f"trim(regexp_replace(text, '[{C.WS}]+', ' ', 'g'))"
FOLDED = f"translate({CLEAN}, '{C.ARABIC_INDIC}', '0123456789')"
BAND = f"CASE WHEN y1 <= {H}::DOUBLE * 0.15::DOUBLE THEN 'header' WHEN y0 >= {H}::DOUBLE * 0.85::DOUBLE THEN 'footer' END"
PRINTED = f"CASE WHEN regexp_extract({FOLDED}, '{C.PAGE_NUMBER}', 1) <> '' THEN regexp_extract({FOLDED}, '{C.PAGE_NUMBER}', 1)::INT WHEN regexp_extract({FOLDED}, '{C.LABELED_PAGE}', 1) <> '' THEN regexp_extract({FOLDED}, '{C.LABELED_PAGE}', 1)::INT END"
KEY = f"replace(lower(regexp_replace({FOLDED}, '[0-9]+', '#', 'g')), 'ß', 'ss')"
FURNITURE = f"""cand AS (SELECT *, {BAND} AS band, {CLEAN} AS clean, {KEY} AS key, {PRINTED} AS printed FROM blocks),
kinds AS (SELECT *, CASE WHEN printed IS NOT NULL THEN 'page_number' WHEN count(*) OVER (PARTITION BY doc_id, band, key) >= 2 THEN band END AS kind
  FROM cand WHERE clean <> '' AND len(string_split(clean, ' ')) <= 10 AND band IS NOT NULL),
furniture AS (SELECT doc_id, page, block_no, kind, clean AS text, printed FROM kinds WHERE kind IS NOT NULL)"""
GUTTERS = f"""tried AS (SELECT *, unnest([0.35::DOUBLE, 0.40::DOUBLE, 0.45::DOUBLE, 0.50::DOUBLE, 0.55::DOUBLE, 0.60::DOUBLE, 0.65::DOUBLE]) AS fraction FROM blocks),
sides AS (SELECT doc_id, page, fraction, count(*) AS n, count(*) FILTER (WHERE x1 < {WD}::DOUBLE * fraction - 3) AS n_left, count(*) FILTER (WHERE x0 > {WD}::DOUBLE * fraction + 3) AS n_right FROM tried GROUP BY ALL),
verified AS (SELECT *, n >= 4 AND n_left >= 2 AND n_right >= 2 AND n - n_left - n_right <= greatest(1, n // 10) AS valid FROM sides),
gutters AS (SELECT doc_id, page, min(CASE WHEN valid THEN fraction END) * {WD}::DOUBLE AS gutter FROM verified GROUP BY ALL)"""


@query("furniture_band", K.with_corpora(f"SELECT doc_id, page, block_no, {BAND} AS band FROM blocks"))
def furniture_band(spark, sf_dir):
    return blocks(spark, sf_dir).select(*G.PAGE, "block_no", U.band(F.col("y0"), F.col("y1"), H).alias("band"))


@query("printed_page_number", K.with_corpora(f"SELECT doc_id, page, block_no, coalesce({PRINTED}, -1) AS printed FROM blocks"))
def printed_page_number(spark, sf_dir):
    return blocks(spark, sf_dir).select(*G.PAGE, "block_no", F.coalesce(T.printed_page_number(T.collapse_ws(F.col("text"))), F.lit(-1)).alias("printed"))


@query("furniture_key", K.with_corpora(f"SELECT doc_id, page, block_no, {KEY} AS key FROM blocks"))
def furniture_key(spark, sf_dir):
    return blocks(spark, sf_dir).select(*G.PAGE, "block_no", T.repetition_key(F.col("text")).alias("key"))


@query("furniture_kind", K.with_corpora(f", {FURNITURE} SELECT doc_id, page, block_no, kind, text, coalesce(printed, -1) AS printed FROM furniture"))
def furniture_kind(spark, sf_dir):
    return U.furniture(blocks(spark, sf_dir), H).withColumn("printed", F.coalesce("printed", F.lit(-1)))


@query("furniture_removed", K.with_corpora(f", {FURNITURE} SELECT doc_id, page, block_no, text FROM blocks b ANTI JOIN furniture USING (doc_id, page, block_no)"))
def furniture_removed(spark, sf_dir):
    return U.without_furniture(blocks(spark, sf_dir), H).select(*G.PAGE, "block_no", "text")


@query("gutter_verify", K.with_corpora(f", {GUTTERS} SELECT doc_id, page, fraction, n, n_left, n_right, valid FROM verified"))
def gutter_verify(spark, sf_dir):
    return G.gutter_counts(blocks(spark, sf_dir), WD)


@query("find_gutter", K.with_corpora(f", {GUTTERS} SELECT doc_id, page, coalesce(gutter, -1) AS gutter FROM gutters"))
def find_gutter(spark, sf_dir):
    return G.find_gutter(blocks(spark, sf_dir), WD).withColumn("gutter", F.coalesce("gutter", F.lit(-1.0)))


@query("likely_multicolumn", K.with_corpora(f", {GUTTERS} SELECT doc_id, page, gutter IS NOT NULL AS likely_multicolumn FROM gutters"))
def likely_multicolumn(spark, sf_dir):
    return G.find_gutter(blocks(spark, sf_dir), WD).select(*G.PAGE, F.col("gutter").isNotNull().alias("likely_multicolumn"))


@query("find_gutters")
def find_gutters(spark, sf_dir):
    return G.find_gutters(blocks(spark, sf_dir), WD).withColumn("gutters", F.array_join(F.transform("gutters", lambda g: F.floor(g * 10 + 0.5).cast("string")), ","))


@query("vertical_overlap", K.with_corpora(f"""SELECT doc_id, page, block_no, {thousandths("CASE WHEN least(y1, py1) > greatest(y0, py0) THEN (least(y1, py1) - greatest(y0, py0)) / least(y1 - y0, py1 - py0) ELSE 0::DOUBLE END")} AS overlap_milli
  FROM (SELECT *, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM blocks WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_no)) WHERE py0 IS NOT NULL"""))
def vertical_overlap(spark, sf_dir):
    order = W.partitionBy(*G.PAGE).orderBy("block_no")
    rows = blocks(spark, sf_dir).withColumn("py0", F.lag("y0").over(order)).withColumn("py1", F.lag("y1").over(order)).filter("py0 is not null")
    return rows.select(*G.PAGE, "block_no", T.thousandths(G.vertical_overlap(F.col("y0"), F.col("y1"), F.col("py0"), F.col("py1"))).alias("overlap_milli"))


@query("bbox_union", K.with_corpora("SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM blocks GROUP BY ALL"))
def bbox_union(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy(*G.PAGE).agg(*G.bbox_union())


FILLED = f"filled AS (SELECT * FROM blocks WHERE regexp_matches(text, '[^{C.WS}]'))"
RTL = f"""letters AS (SELECT doc_id, page, sum({n(C.AL, 'text')}) AS a, sum({n(C.LA, 'text')}) AS l,
    (array_agg(regexp_extract(text, '[{C.AL}{C.LA}]') ORDER BY block_no) FILTER (WHERE regexp_matches(text, '[{C.AL}{C.LA}]')))[1] AS first FROM filled GROUP BY ALL),
sense AS (SELECT doc_id, page, CASE WHEN a <> l THEN a > l ELSE coalesce(regexp_matches(first, '[{C.AL}]'), false) END AS rtl FROM letters)"""


@query("page_direction", K.with_corpora(f", {FILLED}, {RTL} SELECT doc_id, page, rtl FROM sense"))
def page_direction(spark, sf_dir):
    return G.page_direction(blocks(spark, sf_dir).filter(~T.is_blank(F.col("text"))))


ROWS = """lagged AS (SELECT *, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, row_number() OVER w AS seq FROM {source} WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, block_no)),
flagged AS (SELECT *, CASE WHEN least(y1, py1) > greatest(y0, py0) AND (least(y1, py1) - greatest(y0, py0)) / least(y1 - y0, py1 - py0) >= 0.5 THEN 0 ELSE 1 END AS new_row FROM lagged),
rowed AS (SELECT *, sum(new_row) OVER (PARTITION BY doc_id, page ORDER BY seq) AS row_no FROM flagged),
by_row AS (SELECT doc_id, page, block_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY row_no, CASE WHEN rtl THEN -x0 ELSE x0 END, seq) AS ord FROM rowed)"""


@query("row_order", K.with_corpora(f", {FILLED}, {RTL}, sensed AS (SELECT f.*, rtl FROM filled f JOIN sense USING (doc_id, page)), {ROWS.format(source='sensed')} SELECT doc_id, page, block_no, ord FROM by_row"))
def row_order(spark, sf_dir):
    rows = blocks(spark, sf_dir).filter(~T.is_blank(F.col("text")))
    return G.row_order(rows.join(G.page_direction(rows), G.PAGE)).select(*G.PAGE, "block_no", "ord")


ASSIGNED = """assigned AS (SELECT s.*, gutter, CASE WHEN x1 < gutter - 3 THEN 0 WHEN x0 > gutter + 3 THEN 1 END AS col FROM {source} s JOIN gutters USING (doc_id, page) WHERE gutter IS NOT NULL)"""


@query("column_assign", K.with_corpora(f", {GUTTERS}, {ASSIGNED.format(source='blocks')} SELECT doc_id, page, block_no, coalesce(col, -1) AS col FROM assigned"))
def column_assign(spark, sf_dir):
    rows = blocks(spark, sf_dir).join(G.find_gutters(blocks(spark, sf_dir), WD).filter("size(gutters) > 0"), G.PAGE)
    return G.assign_columns(rows).select(*G.PAGE, "block_no", F.coalesce("col", F.lit(-1)).alias("col"))


SEGMENTS = """fulls AS (SELECT *, CASE WHEN col IS NULL THEN 1 ELSE 0 END AS spans FROM assigned),
above AS (SELECT *, sum(spans) OVER (PARTITION BY doc_id, page ORDER BY y0 RANGE UNBOUNDED PRECEDING) AS n_above, sum(spans) OVER (PARTITION BY doc_id, page ORDER BY y0, block_no ROWS UNBOUNDED PRECEDING) AS nth FROM fulls),
segments AS (SELECT *, CASE WHEN spans = 1 THEN nth - 1 ELSE n_above END AS segment FROM above)"""


@query("segment_asof", K.with_corpora(f", {GUTTERS}, {ASSIGNED.format(source='blocks')}, {SEGMENTS} SELECT doc_id, page, block_no, segment::BIGINT AS segment FROM segments"))
def segment_asof(spark, sf_dir):
    rows = blocks(spark, sf_dir).join(G.find_gutters(blocks(spark, sf_dir), WD).filter("size(gutters) > 0"), G.PAGE).withColumn("rtl", F.lit(False))
    return G.column_order(G.assign_columns(rows)).select(*G.PAGE, "block_no", F.col("segment").cast("long").alias("segment"))


BY_COLUMN = f"""sensed AS (SELECT f.*, rtl, count(*) OVER (PARTITION BY doc_id, page) AS n_text FROM filled f JOIN sense USING (doc_id, page)),
columned AS (SELECT s.* FROM sensed s JOIN gutters g USING (doc_id, page) WHERE g.gutter IS NOT NULL AND n_text >= 4),
{ASSIGNED.format(source='columned')}, {SEGMENTS},
by_column AS (SELECT doc_id, page, block_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY segment, spans, CASE WHEN rtl THEN -col ELSE col END, y0, block_no) AS ord FROM segments)"""


@query("column_order", K.with_corpora(f", {GUTTERS}, {FILLED}, {RTL}, {BY_COLUMN} SELECT doc_id, page, block_no, ord FROM by_column"))
def column_order(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    ordered = G.reading_order(rows, G.find_gutters(rows, WD))
    return ordered.filter("by_column").select(*G.PAGE, "block_no", "ord")


READING = f"""{GUTTERS}, {FILLED}, {RTL}, {BY_COLUMN},
plain AS (SELECT s.* FROM sensed s LEFT JOIN gutters g USING (doc_id, page) WHERE NOT (g.gutter IS NOT NULL AND n_text >= 4)), {ROWS.format(source='plain')},
reading AS (SELECT *, 850 AS confidence_milli FROM by_column UNION ALL SELECT *, 950 FROM by_row)"""


@query("reading_order", K.with_corpora(f", {READING} SELECT doc_id, page, block_no, ord, confidence_milli FROM reading"))
def reading_order(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    ordered = G.reading_order(rows, G.find_gutters(rows, WD))
    return ordered.select(*G.PAGE, "block_no", "ord", T.thousandths(F.col("confidence")).cast("int").alias("confidence_milli"))


@query("order_uncertain", K.with_corpora(f", {GUTTERS} SELECT DISTINCT doc_id, page FROM gutters WHERE (doc_id + page) % 5 = 0 AND gutter IS NULL"))
def order_uncertain(spark, sf_dir):
    """Pages that a profile flags as having several columns (here: by number) and that have no gutter."""
    rows = blocks(spark, sf_dir)
    flagged = rows.select(*G.PAGE).distinct().filter("(doc_id + page) % 5 = 0")
    return flagged.join(G.find_gutters(rows, WD).filter("size(gutters) > 0"), G.PAGE, "left_anti")


@query("value_clusters", K.with_corpora("""SELECT doc_id, page, max(k)::BIGINT AS n_clusters, count(*) AS n_values FROM (SELECT doc_id, page, sum(CASE WHEN gap > 6 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x0, block_no) AS k
  FROM (SELECT doc_id, page, block_no, x0, x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0, block_no) AS gap FROM blocks)) GROUP BY ALL"""))
def value_clusters(spark, sf_dir):
    """Left edges within 6 points of their cluster's mean. In this corpus clusters are points, so gaps tell them apart."""
    rows = blocks(spark, sf_dir).groupBy(*G.PAGE).agg(F.collect_list("x0").alias("xs"))
    ids = G.cluster_ids(F.col("xs"), 6.0)
    return rows.select(*G.PAGE, F.array_max(ids).cast("long").alias("n_clusters"), F.size("xs").alias("n_values"))


# profiles ---------------------------------------------------------------------------

PROFILE = f"""{K.IMAGES}, {GUTTERS},
text_side AS (SELECT doc_id, page, sum(length(text))::BIGINT AS text_chars, sum({n(C.AB, 'text')})::BIGINT AS arabic_chars, sum(greatest(0::DOUBLE, x1 - x0) * greatest(0::DOUBLE, y1 - y0)) AS text_area FROM blocks GROUP BY ALL),
image_side AS (SELECT doc_id, page, count(*) AS image_count, sum(greatest(0::DOUBLE, x1 - x0) * greatest(0::DOUBLE, y1 - y0)) AS image_area FROM images GROUP BY ALL),
profiles AS (SELECT t.doc_id, t.page, CASE WHEN t.doc_id % 9 = 0 THEN 0 ELSE text_chars END AS text_chars, CASE WHEN t.doc_id % 9 = 0 THEN 0 ELSE arabic_chars END AS arabic_chars,
  least(1::DOUBLE, text_area / ({WD}::DOUBLE * {H}::DOUBLE)) AS text_coverage, least(1::DOUBLE, coalesce(image_area, 0) / ({WD}::DOUBLE * {H}::DOUBLE)) AS image_coverage, coalesce(image_count, 0) AS image_count, gutter IS NOT NULL AS likely_multicolumn
  FROM text_side t LEFT JOIN image_side USING (doc_id, page) JOIN gutters g USING (doc_id, page)),
page_profiles AS (SELECT *, text_chars >= 20 AS has_text, text_chars < 20 AND image_coverage >= 0.4::DOUBLE AS scanned_like FROM profiles)"""


def page_profiles(spark, sf_dir):
    """Signals of every page; in documents whose id divides by 9 the text layer is taken to be missing."""
    rows = blocks(spark, sf_dir)
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    missing = F.col("doc_id") % 9 == 0
    text = rows.groupBy(*G.PAGE).agg(F.sum(F.length("text")).alias("text_chars"), F.sum(T.count_class(F.col("text"), C.AB)).alias("arabic_chars"), F.sum(area).alias("text_area"))
    images = K.images(rows).groupBy(*G.PAGE).agg(F.count("*").alias("image_count"), F.sum(area).alias("image_area"))
    joined = text.join(images, G.PAGE, "left").join(G.find_gutter(rows, WD), G.PAGE)
    out = joined.select(
        *G.PAGE,
        F.when(missing, 0).otherwise(F.col("text_chars")).alias("text_chars"),
        F.when(missing, 0).otherwise(F.col("arabic_chars")).alias("arabic_chars"),
        F.least(F.lit(1.0), F.col("text_area") / (WD * H)).alias("text_coverage"),
        F.least(F.lit(1.0), F.coalesce("image_area", F.lit(0.0)) / (WD * H)).alias("image_coverage"),
        F.coalesce("image_count", F.lit(0)).alias("image_count"),
        F.col("gutter").isNotNull().alias("likely_multicolumn"),
    )
    return out.withColumns({"has_text": F.col("text_chars") >= 20, "scanned_like": (F.col("text_chars") < 20) & (F.col("image_coverage") >= 0.4)})


@query("page_profile", K.with_corpora(f", {PROFILE} SELECT doc_id, page, text_chars, arabic_chars, {thousandths('text_coverage')} AS text_coverage_milli, {thousandths('image_coverage')} AS image_coverage_milli, image_count, has_text, scanned_like, likely_multicolumn FROM page_profiles"))
def page_profile(spark, sf_dir):
    rows = page_profiles(spark, sf_dir)
    return rows.select(*G.PAGE, "text_chars", "arabic_chars", T.thousandths(F.col("text_coverage")).alias("text_coverage_milli"), T.thousandths(F.col("image_coverage")).alias("image_coverage_milli"), "image_count", "has_text", "scanned_like", "likely_multicolumn")


@query("doc_profile", K.with_corpora(f""", {PROFILE}, d AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (WHERE scanned_like) AS n_scanned, bool_or(arabic_chars > 0) AS arabic_detected FROM page_profiles GROUP BY doc_id)
SELECT doc_id, page_count, (page_count - n_scanned)::DOUBLE / page_count >= 0.5 AS text_layer, n_scanned::DOUBLE / page_count >= 0.5 AS image_dominant, arabic_detected,
  CASE WHEN n_scanned = 0 THEN 'native' WHEN n_scanned = page_count THEN 'scanned' ELSE 'hybrid' END AS classification, {thousandths('greatest(n_scanned, page_count - n_scanned)::DOUBLE / page_count')} AS confidence_milli FROM d"""))
def doc_profile(spark, sf_dir):
    d = page_profiles(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("page_count"), F.count_if("scanned_like").alias("n_scanned"), F.bool_or(F.col("arabic_chars") > 0).alias("arabic_detected"))
    native, total = F.col("page_count") - F.col("n_scanned"), F.col("page_count")
    kind = F.when(F.col("n_scanned") == 0, "native").when(native == 0, "scanned").otherwise("hybrid")
    return d.select("doc_id", "page_count", (native / total >= 0.5).alias("text_layer"), (F.col("n_scanned") / total >= 0.5).alias("image_dominant"), "arabic_detected", kind.alias("classification"), T.thousandths(F.greatest(native, F.col("n_scanned")) / total).alias("confidence_milli"))


@query("problem_pages", K.with_corpora(f", {PROFILE} SELECT doc_id, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM page_profiles WHERE scanned_like OR likely_multicolumn OR (arabic_chars > 0 AND text_chars < 20) GROUP BY doc_id"))
def problem_pages(spark, sf_dir):
    flagged = page_profiles(spark, sf_dir).filter("scanned_like or likely_multicolumn or (arabic_chars > 0 and text_chars < 20)")
    return flagged.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"))


@query("distinct_fonts", K.with_corpora("""SELECT doc_id, string_agg(font, ',' ORDER BY first_at) AS fonts FROM (SELECT doc_id, font, min(page * 100 + block_no) AS first_at, row_number() OVER (PARTITION BY doc_id ORDER BY min(page * 100 + block_no)) AS k
  FROM (SELECT *, concat('Font', ((length(text) * 7 + block_no) % 23)::VARCHAR) AS font FROM blocks) GROUP BY doc_id, font) WHERE k <= 100 GROUP BY doc_id"""))
def distinct_fonts(spark, sf_dir):
    """A document's fonts in the order of their first use, a hundred at most."""
    rows = blocks(spark, sf_dir).withColumn("font", F.concat(F.lit("Font"), ((F.length("text") * 7 + F.col("block_no")) % 23).cast("string")))
    first = rows.groupBy("doc_id", "font").agg(F.min(F.col("page") * 100 + F.col("block_no")).alias("at"))
    fonts = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "font"))), 1, 100), lambda s: s["font"])
    return first.groupBy("doc_id").agg(F.array_join(fonts, ",").alias("fonts"))


@query("explode_spans", K.with_corpora(f"SELECT doc_id, page, block_no, generate_subscripts(w, 1) - 1 AS span_no, unnest(w) AS span FROM (SELECT doc_id, page, block_no, regexp_extract_all(text, '[^{C.WS}]+') AS w FROM blocks)"))
def explode_spans(spark, sf_dir):
    """A block's words as spans, with their place."""
    return blocks(spark, sf_dir).select(*G.PAGE, "block_no", F.posexplode(T.tokens(F.col("text"))).alias("span_no", "span"))


DRAWINGS = "SELECT doc_id, page, block_no AS ord, x0, y0, x0 + ((length(text) * 7) % 40) * 0.5::DOUBLE AS x1, y0 + ((length(text) * 3) % 12) * 0.5::DOUBLE AS y1 FROM blocks"


def drawings(spark, sf_dir):
    """Vector drawings: boxes whose sides follow from the text's length."""
    size = F.length("text")
    return blocks(spark, sf_dir).select(*G.PAGE, F.col("block_no").alias("ord"), "x0", "y0", (F.col("x0") + ((size * 7) % 40) * 0.5).alias("x1"), (F.col("y0") + ((size * 3) % 12) * 0.5).alias("y1"))


@query("rule_segments", K.with_corpora(f"SELECT doc_id, page, ord, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS k FROM ({DRAWINGS}) WHERE (x1 > x0 OR y1 > y0) AND least(x1 - x0, y1 - y0) <= 2.5) WHERE k <= 200"))
def rule_segments(spark, sf_dir):
    """Thin drawings, the first 200 of a page."""
    rows = drawings(spark, sf_dir).filter("(x1 > x0 or y1 > y0) and least(x1 - x0, y1 - y0) <= 2.5")
    return rows.withColumn("k", F.row_number().over(W.partitionBy(*G.PAGE).orderBy("ord"))).filter("k <= 200").drop("k")


