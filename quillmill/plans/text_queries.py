"""Queries over the script corpus: characters, scripts, language, integrity, runs, names."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from quillmill.functions import chars as C
from quillmill.functions import text as T
from quillmill.plans import corpora as K
from quillmill.plans.registry import n, query, quoted, thousandths

def col_t():
    return F.col("t")


def over(sql: str) -> str:
    return K.with_corpora(f"SELECT doc_id, {sql} FROM scripts")


SCRIPT = f"CASE WHEN {n(C.AL)} > 0 AND {n(C.LA)} > 0 THEN 'Mixed' WHEN {n(C.AL)} > 0 THEN 'Arabic' WHEN {n(C.LA)} > 0 THEN 'Latin' WHEN {n(C.ND)} > 0 THEN 'Numeric' ELSE 'Neutral' END"


def script_sql(col: str) -> str:
    return SCRIPT.replace("(t,", f"({col},")


FIRST = f"regexp_extract(t, '[{C.AL}{C.LA}]')"
DIRECTION = f"CASE WHEN {FIRST} = '' THEN NULL WHEN regexp_matches({FIRST}, '[{C.AL}]') THEN 'rtl' ELSE 'ltr' END"
NOT_WS = f"[^{C.WS}]"
TOKENS = f"regexp_extract_all(t, '{NOT_WS}+')"
FLAGS = f"array_to_string(list_transform({TOKENS}, lambda k: CASE WHEN regexp_matches(k, '^[{C.MK}]*[{C.AL}][{C.MK}]*$') THEN '1' ELSE '0' END), '')"
LONGEST = f"coalesce(list_max(list_transform(regexp_extract_all({FLAGS}, '1+'), lambda r: length(r))), 0)"
ORPHANS = rf"len(regexp_extract_all(t, '(?:\A|[{C.WS}])[{C.MK}]'))"
WORDS = f"list_filter({TOKENS}, lambda w: regexp_matches(w, '[{C.AB}]'))"
INITIAL = f"list_filter({WORDS}, lambda w: regexp_matches(w, '^[{C.HARAKAT}]'))"
UNUSUAL = f"({n(C.LT)} - {n(C.AL)} - ({n(C.LA)} - {n('×÷')}))"
LINES = rf"regexp_split_to_array(t, '\r\n|[{C.LB}]')"
JUMPS = rf"[i FOR i IN range(1, len({LINES}) + 1) IF regexp_matches(({LINES})[i], '\A[{C.WS}]*[.،؛؟۔:!?]') AND NOT regexp_matches(({LINES})[i], '[{C.AL}{C.LA}]')]"
ADJACENT = f"(len(regexp_extract_all(t, '[{C.DIGITS}][{C.ARABIC_PUNCTUATION}]')) + len(regexp_extract_all(t, '[{C.ARABIC_PUNCTUATION}][{C.DIGITS}]')))"


@query("script_profile", over(f"{n(C.AL)} AS arabic_letters, {n(C.LA)} AS latin_letters, {n(C.ND)} AS digits, length(t) - {n(C.AL)} - {n(C.LA)} - {n(C.ND)} AS neutral, {n(C.BC)} AS bidi_controls"))
def script_profile(spark, sf_dir):
    a, la, d = T.arabic_letters(col_t()), T.latin_letters(col_t()), T.digits(col_t())
    return K.scripts(spark, sf_dir).select("doc_id", a.alias("arabic_letters"), la.alias("latin_letters"), d.alias("digits"), (F.length(col_t()) - a - la - d).alias("neutral"), T.count_class(col_t(), C.BC).alias("bidi_controls"))


@query("script_class", over(f"{SCRIPT} AS script"))
def script_class(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", T.script_class(col_t()).alias("script"))


@query("first_strong", over(f"{DIRECTION} AS dir"))
def first_strong(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", T.direction(col_t()).alias("dir"))


@query("script_confidence", over(f"CASE WHEN {n(C.AL)} + {n(C.LA)} = 0 THEN 0 ELSE {thousandths(f'greatest({n(C.AL)}, {n(C.LA)})::DOUBLE / ({n(C.AL)} + {n(C.LA)})')} END AS confidence_milli, {SCRIPT} AS script, {DIRECTION} AS dir"))
def script_confidence(spark, sf_dir):
    a, la = T.arabic_letters(col_t()), T.latin_letters(col_t())
    share = F.when(a + la == 0, 0).otherwise(T.thousandths(F.greatest(a, la) / (a + la)))
    return K.scripts(spark, sf_dir).select("doc_id", share.cast("long").alias("confidence_milli"), T.script_class(col_t()).alias("script"), T.direction(col_t()).alias("dir"))


@query("dominant_script", over(f"CASE WHEN {SCRIPT} = 'Mixed' THEN CASE WHEN {n(C.AL)} > {n(C.LA)} THEN 'Arabic' ELSE 'Latin' END ELSE {SCRIPT} END AS script"))
def dominant_script(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", T.dominant_script(col_t()).alias("script"))


@query("detect_scripts", over(f"{SCRIPT} AS script, {DIRECTION} AS dir, length(t) AS n_chars"))
def detect_scripts(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", T.script_class(col_t()).alias("script"), T.direction(col_t()).alias("dir"), F.length(col_t()).alias("n_chars"))


@query("arabic_chars", over(f"{n(C.AB)} AS arabic_chars"))
def arabic_chars(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", T.count_class(col_t(), C.AB).alias("arabic_chars"))


@query("contains_arabic", over(r"regexp_matches(t, '[\x{0600}-\x{06FF}\x{FB50}-\x{FEFF}]') AS contains_arabic"))
def contains_arabic(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", col_t().rlike(r"[\x{0600}-\x{06FF}\x{FB50}-\x{FEFF}]").alias("contains_arabic"))


@query("presentation_rate", over(f"{n(C.PF)} AS n_forms, {n(C.LT)} AS n_letters, CASE WHEN {n(C.LT)} = 0 THEN 0 ELSE {thousandths(f'{n(C.PF)}::DOUBLE / {n(C.LT)}')} END AS rate_milli"))
def presentation_rate(spark, sf_dir):
    forms, letters = T.count_class(col_t(), C.PF), T.letters(col_t())
    rate = F.when(letters == 0, 0).otherwise(T.thousandths(forms / letters))
    return K.scripts(spark, sf_dir).select("doc_id", forms.alias("n_forms"), letters.alias("n_letters"), rate.cast("long").alias("rate_milli"))


@query("unusual_letters", over(f"{UNUSUAL} AS unusual_letters"))
def unusual_letters(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", T.unusual_letters(col_t()).alias("unusual_letters"))


@query("bidi_controls", over(f"{n(C.BC)} AS n_controls, {n(C.BC)} > 0 AS present"))
def bidi_controls(spark, sf_dir):
    count = T.count_class(col_t(), C.BC)
    return K.scripts(spark, sf_dir).select("doc_id", count.alias("n_controls"), (count > 0).alias("present"))


@query("spacing_stats", over(f"{LONGEST} >= 3 AS suspicious, len(regexp_extract_all({FLAGS}, '1+')) AS runs, {LONGEST} AS longest_run, length(replace({FLAGS}, '0', '')) AS isolated_tokens"))
def spacing_stats(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in T.spacing(col_t()).items()))


@query("mark_stats", over(f"{n(C.MK)} AS combining_marks, {n(C.HARAKAT)} AS harakat, length(t) - length(replace(t, '{C.SHADDA}', '')) AS shadda, {n(C.QURANIC)} AS quranic_annotations, {ORPHANS} AS orphans"))
def mark_stats(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in T.marks(col_t()).items()))


@query("mark_initial_rate", over(f"len({INITIAL}) AS n_initial, len({WORDS}) AS n_words"))
def mark_initial_rate(spark, sf_dir):
    initial, words = T.mark_initial(col_t())
    return K.scripts(spark, sf_dir).select("doc_id", initial.alias("n_initial"), words.alias("n_words"))


@query("punctuation_jumps", over(f"len({JUMPS}) AS n_jumps, array_to_string(({JUMPS})[1:5], ',') AS first_lines"))
def punctuation_jumps(spark, sf_dir):
    jumps = T.punctuation_jumps(col_t())
    return K.scripts(spark, sf_dir).select("doc_id", F.size(jumps).alias("n_jumps"), F.array_join(F.transform(F.slice(jumps, 1, 5), lambda j: j.cast("string")), ",").alias("first_lines"))


@query("bidi_digit_punct", over(f"{ADJACENT} AS n_adjacent"))
def bidi_digit_punct(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", T.digit_punctuation(col_t()).alias("n_adjacent"))


BIDI = f"""array_to_string(list_filter([CASE WHEN {n(C.BC)} > 0 THEN 'BIDI_CONTROL_PRESENT:info' END, CASE WHEN len({JUMPS}) > 0 THEN 'PUNCTUATION_JUMP:warning' END,
  CASE WHEN doc_id % 2 = 0 AND {n(C.AL)} > 0 AND {n(C.LA)} > 0 THEN 'UNISOLATED_MIXTURE:warning' END, CASE WHEN {ADJACENT} > 0 THEN 'DIGIT_ARABIC_PUNCTUATION:info' END], lambda x: x IS NOT NULL), ',')"""


@query("bidi_issues", over(f"{BIDI} AS issues"))
def bidi_issues(spark, sf_dir):
    """Mixtures count as not isolated in documents of even id."""
    mixed = (F.col("doc_id") % 2 == 0) & T.has_class(col_t(), C.AL) & T.has_class(col_t(), C.LA)
    issues = F.concat_ws(
        ",",
        F.when(T.count_class(col_t(), C.BC) > 0, "BIDI_CONTROL_PRESENT:info"),
        F.when(F.size(T.punctuation_jumps(col_t())) > 0, "PUNCTUATION_JUMP:warning"),
        F.when(mixed, "UNISOLATED_MIXTURE:warning"),
        F.when(T.digit_punctuation(col_t()) > 0, "DIGIT_ARABIC_PUNCTUATION:info"),
    )
    return K.scripts(spark, sf_dir).select("doc_id", issues.alias("issues"))


#: One row per text with the components of its integrity score, for the SQL of this and other queries.
def integrity_cte(source: str, keys: str, text: str) -> str:
    counted = f"""SELECT {keys}, {text} AS t FROM {source}"""
    return f"""counted AS (SELECT {keys}, t, {n(C.LT)} AS n_letters, {n(C.PF)} AS n_forms, {UNUSUAL} AS n_unusual, {LONGEST} AS longest, {ORPHANS} AS n_orphans,
    len({INITIAL}) AS n_initial, len({WORDS}) AS n_words, len({JUMPS}) AS n_jumps, {n(C.AL)} AS n_arabic FROM ({counted})),
penalties AS (SELECT *, CASE WHEN n_letters > 0 THEN least(0.25::DOUBLE, n_forms::DOUBLE / n_letters * 0.4::DOUBLE) ELSE 0::DOUBLE END AS forms,
    least(0.3::DOUBLE, n_unusual * 0.05::DOUBLE) AS unusual, CASE WHEN longest >= 3 THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS spaced,
    least(0.2::DOUBLE, n_orphans * 0.05::DOUBLE) AS orphans, CASE WHEN n_words > 0 THEN n_initial::DOUBLE / n_words ELSE 0::DOUBLE END AS rate FROM counted),
scored AS (SELECT *, CASE WHEN rate >= 0.2::DOUBLE THEN least(0.45::DOUBLE, greatest(0.3::DOUBLE, rate * 0.6::DOUBLE)) ELSE 0::DOUBLE END AS reversal,
    CASE WHEN n_arabic > 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, 1::DOUBLE - forms - unusual - spaced - orphans
      - (CASE WHEN rate >= 0.2::DOUBLE THEN least(0.45::DOUBLE, greatest(0.3::DOUBLE, rate * 0.6::DOUBLE)) ELSE 0::DOUBLE END) - (CASE WHEN n_jumps > 0 THEN 1 ELSE 0 END) * 0.1::DOUBLE)) END AS score FROM penalties)"""


LEVEL = "CASE WHEN score >= 0.85::DOUBLE THEN 'good' WHEN score >= 0.6::DOUBLE THEN 'review_recommended' WHEN score IS NOT NULL THEN 'problem_likely' END"


def scored(frame, *keys: str):
    """``keys``, score and level of the texts in column t."""
    rows = T.with_penalties(frame.select(*keys, "t")).select(*keys, "t", "forms", "unusual", "spaced", "orphans", "reversal", "score")
    return rows.withColumn("level", T.integrity_level(F.col("score")))


@query("integrity_score", K.with_corpora(f", {integrity_cte('scripts', 'doc_id', 't')} SELECT doc_id, coalesce({thousandths('score')}, -1) AS score_milli, {thousandths('forms')} AS forms_milli, n_unusual, longest, n_orphans, n_initial, n_words, n_jumps FROM scored"))
def integrity_score(spark, sf_dir):
    rows = T.with_integrity(K.scripts(spark, sf_dir))
    counts = ("n_unusual", "longest", "n_orphans", "n_initial", "n_words", "n_jumps")
    return rows.select("doc_id", F.coalesce(T.thousandths(F.col("score")), F.lit(-1)).alias("score_milli"), T.thousandths(F.col("forms")).alias("forms_milli"), *counts)


@query("integrity_level", K.with_corpora(f", {integrity_cte('scripts', 'doc_id', 't')} SELECT doc_id, {LEVEL} AS level FROM scored"))
def integrity_level(spark, sf_dir):
    return scored(K.scripts(spark, sf_dir), "doc_id").select("doc_id", "level")


_STRIPPED = rf"regexp_replace(t, '\A[{C.WS}]+|[{C.WS}]+\z', '', 'g')"
_LANG_WORDS = f"list_transform(regexp_extract_all(s, '{NOT_WS}+'), lambda w: lower(regexp_replace(w, '^{quoted(C.EDGE_PUNCTUATION)}|{quoted(C.EDGE_PUNCTUATION)}$', '', 'g')))"
_HITS = "len(list_filter(words, lambda w: list_contains([{}], w)))"


def language_cte(source: str, keys: str, text: str) -> str:
    ind, eng = (_HITS.format(", ".join(f"'{w}'" for w in ws)) for ws in (C.INDONESIAN, C.ENGLISH))
    return f"""stripped AS (SELECT {keys}, {_STRIPPED} AS s FROM (SELECT {keys}, {text} AS t FROM {source})),
worded AS (SELECT *, {script_sql('s')} AS script, {n(C.AB, 's')} > length(s) // 2 AS mostly, {_LANG_WORDS} AS words FROM stripped),
hits AS (SELECT *, {ind} AS ind, {eng} AS eng FROM worded),
labelled AS (SELECT {keys}, script, CASE WHEN script = 'Arabic' OR mostly THEN 'ar' WHEN script = 'Mixed' THEN CASE WHEN ind >= eng THEN 'id' ELSE 'en' END WHEN ind > eng THEN 'id' WHEN eng > ind THEN 'en' ELSE 'unknown' END AS lang,
  CASE WHEN script = 'Arabic' OR mostly THEN 0 WHEN script = 'Mixed' OR ind <> eng THEN greatest(ind, eng) ELSE 0 END AS hits FROM hits)"""


@query("detect_language", K.with_corpora(f", {language_cte('scripts', 'doc_id', 't')} SELECT doc_id, lang, hits FROM labelled"))
def detect_language(spark, sf_dir):
    return T.with_language(K.scripts(spark, sf_dir)).select("doc_id", "lang", "hits")


# runs and markup ----------------------------------------------------------------

_RUN_SCRIPT = f"CASE WHEN regexp_extract(run, '[{C.AL}{C.LA}]') = '' THEN 'Neutral' WHEN regexp_matches(regexp_extract(run, '[{C.AL}{C.LA}]'), '[{C.AL}]') THEN 'Arabic' ELSE 'Latin' END"


def _run_script(run):
    d = T.direction(run)
    return F.when(d.isNull(), "Neutral").when(d == "rtl", "Arabic").otherwise("Latin")


def _runs_sql(pattern: str) -> str:
    return f"SELECT doc_id, generate_subscripts(r, 1) - 1 AS run_no, unnest(r) AS run FROM (SELECT doc_id, {pattern} AS r FROM scripts)"


@query("script_runs", K.with_corpora(f"SELECT doc_id, run_no, run, {_RUN_SCRIPT} AS script FROM ({_runs_sql(f"regexp_extract_all(t, '{C.SCRIPT_RUN}')")})"))
def script_runs(spark, sf_dir):
    rows = K.scripts(spark, sf_dir).select("doc_id", F.posexplode(T.script_runs(col_t())).alias("run_no", "run"))
    return rows.withColumn("script", _run_script(F.col("run")))


@query("edited_content", K.with_corpora(f"SELECT doc_id, run_no, run, CASE WHEN mixed THEN {_RUN_SCRIPT} END AS script FROM (SELECT doc_id, mixed, generate_subscripts(r, 1) - 1 AS run_no, unnest(r) AS run FROM (SELECT doc_id, {SCRIPT} = 'Mixed' AS mixed, CASE WHEN {SCRIPT} = 'Mixed' THEN regexp_extract_all(t, '{C.EDITED_RUN}') ELSE [t] END AS r FROM scripts))"))
def edited_content(spark, sf_dir):
    rows = K.scripts(spark, sf_dir).select("doc_id", F.posexplode(T.edited_runs(col_t())).alias("run_no", "run"))
    rows = rows.withColumn("mixed", F.count("*").over(W.partitionBy("doc_id")) > 1)
    return rows.select("doc_id", "run_no", "run", F.when(F.col("mixed"), _run_script(F.col("run"))).alias("script"))


_NODES = f"""runs AS (SELECT doc_id, run_no, run, {_RUN_SCRIPT} AS script, dominant FROM (SELECT doc_id, dominant, generate_subscripts(r, 1) - 1 AS run_no, unnest(r) AS run
    FROM (SELECT doc_id, CASE WHEN {SCRIPT} = 'Mixed' THEN CASE WHEN {n(C.AL)} > {n(C.LA)} THEN 'Arabic' ELSE 'Latin' END ELSE {SCRIPT} END AS dominant, regexp_extract_all(t, '{C.SCRIPT_RUN}') AS r FROM scripts))),
marked AS (SELECT *, script IN ('Arabic', 'Latin') AND script <> dominant AS minority FROM runs),
islands AS (SELECT *, sum(CASE WHEN NOT minority AND NOT coalesce(before, true) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY run_no) AS node_no
  FROM (SELECT *, lag(minority) OVER (PARTITION BY doc_id ORDER BY run_no) AS before FROM marked))"""


@query("content_nodes", K.with_corpora(f", {_NODES} SELECT doc_id, node_no::BIGINT AS node_no, CASE WHEN bool_or(minority) THEN 'span' ELSE 'text' END AS kind, string_agg(run, '' ORDER BY run_no) AS text, CASE WHEN bool_or(minority) THEN min(script) END AS script FROM islands GROUP BY doc_id, node_no"))
def content_nodes(spark, sf_dir):
    """Runs of the minority script are spans; what stands between them is one text node."""
    rows = K.scripts(spark, sf_dir).select("doc_id", F.posexplode(T.script_runs(col_t())).alias("run_no", "run")).withColumn("script", _run_script(F.col("run")))
    # counted run by run: the text itself does not travel with each of its runs
    doc = W.partitionBy("doc_id")
    arabic, latin = F.sum(T.arabic_letters(F.col("run"))).over(doc), F.sum(T.latin_letters(F.col("run"))).over(doc)
    rows = rows.withColumn("dominant", F.when((arabic > 0) & (latin > 0), F.when(arabic > latin, "Arabic").otherwise("Latin")).otherwise(F.col("script")))
    rows = rows.withColumn("minority", F.col("script").isin("Arabic", "Latin") & (F.col("script") != F.col("dominant")))
    order = W.partitionBy("doc_id").orderBy("run_no")
    joins = ~F.col("minority") & ~F.coalesce(F.lag("minority").over(order), F.lit(True))
    rows = rows.withColumn("node_no", F.sum(F.when(joins, 0).otherwise(1)).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "run"))), lambda s: s["run"]), "")
    nodes = rows.groupBy("doc_id", "node_no").agg(F.bool_or("minority").alias("span"), text.alias("text"), F.min("script").alias("script"))
    return nodes.select("doc_id", "node_no", F.when(F.col("span"), "span").otherwise("text").alias("kind"), "text", F.when(F.col("span"), F.col("script")).alias("script"))


XML = f"regexp_replace(x, '[^{C.XML_LEGAL}]', '', 'g')"
ESCAPED = f"replace(replace(replace({XML}, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"


def escape_sql(col: str) -> str:
    return ESCAPED.replace("(x,", f"({col},")


_QUOTED = f"replace(replace(replace({ESCAPED}, chr(10), '&#10;'), chr(13), '&#13;'), chr(9), '&#9;')"
_NASTY = "concat('<a href=\"', t, chr(9), CASE WHEN doc_id % 3 = 0 THEN '''' ELSE '&' END, chr(8), '\">')"


def quoteattr_sql(col: str) -> str:
    q = _QUOTED.replace("(x,", f"({col},")
    return f"CASE WHEN contains({q}, '\"') AND contains({q}, '''') THEN concat('\"', replace({q}, '\"', '&quot;'), '\"') WHEN contains({q}, '\"') THEN concat('''', {q}, '''') ELSE concat('\"', {q}, '\"') END"


@query("xml_escape", K.with_corpora(f"SELECT doc_id, {ESCAPED} AS escaped, {quoteattr_sql('x')} AS quoted FROM (SELECT doc_id, {_NASTY} AS x FROM scripts)"))
def xml_escape(spark, sf_dir):
    x = F.concat(F.lit('<a href="'), F.col("t"), F.lit("\t"), F.when(F.col("doc_id") % 3 == 0, "'").otherwise("&"), F.lit("\x08"), F.lit('">'))
    rows = K.scripts(spark, sf_dir).select("doc_id", x.alias("x"))
    return rows.select("doc_id", T.escape(F.col("x")).alias("escaped"), T.quoteattr(F.col("x")).alias("quoted"))


_CODES = f"regexp_extract_all(x, '[^{C.XML_LEGAL}]')"


@query("xml_diagnostics", K.with_corpora(f"SELECT doc_id % 10 AS grp, format('U+{{:04X}}', ord(c)) AS codepoint, count(*) AS n, count(DISTINCT doc_id) AS n_blocks FROM (SELECT doc_id, unnest({_CODES}) AS c FROM (SELECT doc_id, concat({_NASTY}, CASE WHEN doc_id % 2 = 0 THEN chr(11) ELSE chr(1) END) AS x FROM scripts)) GROUP BY ALL"))
def xml_diagnostics(spark, sf_dir):
    """Characters that XML cannot hold, by code point, and in how many texts."""
    x = F.concat(F.lit('<a href="'), F.col("t"), F.lit("\t"), F.when(F.col("doc_id") % 3 == 0, "'").otherwise("&"), F.lit("\x08"), F.lit('">'), F.when(F.col("doc_id") % 2 == 0, "\x0b").otherwise("\x01"))
    rows = K.scripts(spark, sf_dir).select("doc_id", F.explode(T.extract_all(x, f"[^{C.XML_LEGAL}]")).alias("c"))
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.conv(F.hex(F.encode("c", "UTF-16BE")), 16, 10).cast("long")), 4, "0"))
    return rows.groupBy((F.col("doc_id") % 10).alias("grp"), code.alias("codepoint")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_blocks"))


_SPACED = "concat(CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE '' END, t, CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE ' ' END)"
_BEFORE, _REST = rf"regexp_extract(x, '\A[{C.WS}]*')", rf"substr(x, length(regexp_extract(x, '\A[{C.WS}]*')) + 1)"
_AFTER = rf"regexp_extract({_REST}, '[{C.WS}]*\z')"


@query("bdi_span", K.with_corpora(f"SELECT doc_id, concat({escape_sql(_BEFORE)}, '<bdi lang=\"ar\" dir=\"rtl\">', {escape_sql(f'substr({_REST}, 1, length({_REST}) - length({_AFTER}))')}, '</bdi>', {escape_sql(_AFTER)}) AS html FROM (SELECT doc_id, {_SPACED} AS x FROM scripts)"))
def bdi_span(spark, sf_dir):
    x = F.concat(F.when(F.col("doc_id") % 2 == 0, "  ").otherwise(""), F.col("t"), F.when(F.col("doc_id") % 3 == 0, "\n").otherwise(" "))
    rows = K.scripts(spark, sf_dir).select("doc_id", x.alias("x"))
    return rows.select("doc_id", T.bdi(F.col("x"), F.lit("ar"), F.lit("rtl")).alias("html"))


@query("collapse_ws", over(f"trim(regexp_replace(t, '[{C.WS}]+', ' ', 'g')) AS clean"))
def collapse_ws(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", T.collapse_ws(col_t()).alias("clean"))


@query("ends_terminal", K.with_corpora(rf"SELECT doc_id, line_no, regexp_matches(line, '[{C.TERMINAL}][{C.WS}]*\z') AS terminal FROM lines"))
def ends_terminal(spark, sf_dir):
    return K.lines(spark, sf_dir).select("doc_id", "line_no", T.ends_terminal(F.col("line")).alias("terminal"))


# normal forms: whole-string Unicode normalisation has no built-in, so it runs in Arrow batches ---------


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@lru_cache(maxsize=1)
def repair_table() -> dict[int, str]:
    """Ligatures and presentation letters to what they stand for; characters that XML cannot hold go."""
    table: dict[int, str] = {c: "" for c in [*range(0x20), *range(0xD800, 0xE000), 0xFFFE, 0xFFFF] if c not in (9, 10, 13)}
    for c in [*range(0xFB00, 0xFB07), *range(0xFB50, 0xFE00), *range(0xFE70, 0xFF00)]:
        folded = unicodedata.normalize("NFKC", chr(c))
        if c <= 0xFB06 or any(unicodedata.category(x)[0] == "L" for x in folded):
            table[c] = folded
    return table


@F.pandas_udf(StringType())
def repair(text: pd.Series) -> pd.Series:
    table = repair_table()
    return text.map(lambda x: x.translate(table), na_action="ignore")


def search_form(text):
    """NFKC, alef variants folded, marks and tatweel dropped: for search only."""
    return F.regexp_replace(F.translate(nfkc(text), "أإآٱ", "اااا"), rf"[{C.MK}\x{{0640}}]", "")


def search_key_form(text):
    """NFKC in lower case without tatweel and marks; alef variants stay."""
    return F.regexp_replace(F.lower(nfkc(text)), r"[\x{0640}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]", "")


@query("search_normalized")
def search_normalized(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", search_form(col_t()).alias("search_text"))


@query("normalize_source")
def normalize_source(spark, sf_dir):
    rows = K.scripts(spark, sf_dir).select("doc_id", "t", nfkc(col_t()).alias("text"))
    changed = F.col("text") != F.col("t")
    return rows.select("doc_id", "text", F.when(changed, F.col("t")).alias("source_text"), F.when(changed, F.array(F.lit("arabic_nfkc_normalization"))).otherwise(F.array()).alias("transformations"))


@query("repair_text")
def repair_text(spark, sf_dir):
    rows = K.scripts(spark, sf_dir).select("doc_id", "t", repair(col_t()).alias("text"))
    return rows.select("doc_id", "text", (F.col("text") != F.col("t")).alias("changed"))


@query("search_key")
def search_key(spark, sf_dir):
    return K.scripts(spark, sf_dir).select("doc_id", search_key_form(col_t()).alias("key"))


# names and labels ------------------------------------------------------------------

_NAME = "concat(source, '/', text, '.pdf')"
_BASE = r"regexp_extract(x, '([^/]*)/*\z', 1)"
_CLEAN = rf"regexp_replace(regexp_replace({_BASE}, '[^A-Za-z0-9._-]+', '_', 'g'), '\A[._]+|[._]+\z', '', 'g')"


@query("sanitize_filename", f"SELECT doc_id, substr(CASE WHEN {_CLEAN} = '' THEN 'document.pdf' ELSE {_CLEAN} END, 1, 120) AS filename FROM (SELECT doc_id, {_NAME} AS x FROM documents)")
def sanitize_filename(spark, sf_dir):
    return K.table(spark, sf_dir, "documents").select("doc_id", T.sanitize_filename(F.concat("source", F.lit("/"), F.col("text"), F.lit(".pdf"))).alias("filename"))


_AUTHORS = "replace(replace(text, ' of ', ' and '), '.', ' &')"


@query("split_authors", rf"SELECT doc_id, array_to_string((list_filter(list_transform(regexp_split_to_array(x, '[,&]|\band\b'), lambda p: regexp_replace(p, '\A[{C.WS}]+|[{C.WS}]+\z', '', 'g')), lambda p: p <> ''))[1:5], '|') AS authors FROM (SELECT doc_id, {_AUTHORS} AS x FROM documents)")
def split_authors(spark, sf_dir):
    x = F.replace(F.replace(F.col("text"), F.lit(" of "), F.lit(" and ")), F.lit("."), F.lit(" &"))
    return K.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.split_authors(x), "|").alias("authors"))


@query("language_codes", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ara,ind,eng' WHEN doc_id % 3 = 1 THEN 'eng,ara' ELSE 'ind' END AS codes FROM documents")
def language_codes(spark, sf_dir):
    langs = F.when(F.col("doc_id") % 3 == 0, F.array(*map(F.lit, ("ar", "ind", "id", "en")))).when(F.col("doc_id") % 3 == 1, F.array(*map(F.lit, ("en", "eng", "ar")))).otherwise(F.array(F.lit("id")))
    return K.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.language_codes(langs), ",").alias("codes"))


_BYTES = "(n_chars * (1 + doc_id % 997))"


@query("format_bytes", f"SELECT doc_id, CASE WHEN b >= 1048576 THEN concat((floor(b / 1048576::DOUBLE * 10 + 0.5::DOUBLE)::BIGINT // 10)::VARCHAR, '.', (floor(b / 1048576::DOUBLE * 10 + 0.5::DOUBLE)::BIGINT % 10)::VARCHAR, ' MB') ELSE concat(greatest(1, floor(b / 1024::DOUBLE + 0.5::DOUBLE)::BIGINT)::VARCHAR, ' KB') END AS size FROM (SELECT doc_id, {_BYTES} AS b FROM documents)")
def format_bytes(spark, sf_dir):
    return K.table(spark, sf_dir, "documents").select("doc_id", T.format_bytes(F.col("n_chars") * (1 + F.col("doc_id") % 997)).alias("size"))


@query("ordered_distinct", "SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'p': list_position(w, x), 'x': x})), lambda s: s.x), ' ') AS words FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def ordered_distinct(spark, sf_dir):
    return K.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(F.split(F.col("text"), " ")), " ").alias("words"))


@query("golden_summary", over(f"{n(C.AL)} AS arabic_letters, {n(C.HARAKAT)} AS harakat, {n(C.PF)} AS presentation_forms, sha256(t) AS text_sha256"))
def golden_summary(spark, sf_dir):
    """Counts over each document's whole text, and its digest."""
    return K.scripts(spark, sf_dir).select("doc_id", T.arabic_letters(col_t()).alias("arabic_letters"), T.count_class(col_t(), C.HARAKAT).alias("harakat"), T.count_class(col_t(), C.PF).alias("presentation_forms"), F.sha2("t", 256).alias("text_sha256"))


@query("has_arabic", K.with_corpora(f"SELECT doc_id, bool_or(regexp_matches(line, '[{C.AB}]')) AS has_arabic FROM lines GROUP BY doc_id"))
def has_arabic(spark, sf_dir):
    return K.lines(spark, sf_dir).groupBy("doc_id").agg(F.bool_or(T.has_class(F.col("line"), C.AB)).alias("has_arabic"))


_MARKED = "concat(CASE (doc_id + line_no) % 6 WHEN 0 THEN '1. ' WHEN 1 THEN '• ' WHEN 2 THEN '- ' WHEN 3 THEN '٣) ' WHEN 4 THEN '12 ' ELSE '' END, line)"


@query("list_markers", K.with_corpora(f"SELECT doc_id, line_no, regexp_extract(x, '{C.LIST_MARKER}') AS marker, regexp_matches(x, '{C.ORDERED_MARKER}') AS ordered, regexp_replace(x, '{C.LIST_MARKER}', '') AS item FROM (SELECT doc_id, line_no, {_MARKED} AS x FROM lines)"))
def list_markers(spark, sf_dir):
    rows = K.lines(spark, sf_dir).selectExpr("doc_id", "line_no", f"{_MARKED} as x")
    x = F.col("x")
    return rows.select("doc_id", "line_no", F.regexp_extract(x, C.LIST_MARKER, 0).alias("marker"), x.rlike(C.ORDERED_MARKER).alias("ordered"), F.regexp_replace(x, C.LIST_MARKER, "").alias("item"))
