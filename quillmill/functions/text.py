"""Column functions over Unicode text: scripts, direction, language, spacing, marks and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import chars as C

SCRIPTS = ("Arabic", "Latin", "Mixed", "Numeric", "Neutral")


def count_class(text: Column, body: str) -> Column:
    """How many characters of a class: what is left without the others. A list of all matches costs many times more."""
    return F.length(F.regexp_replace(text, f"[^{body}]+", ""))


def has_class(text: Column, body: str) -> Column:
    return text.rlike(f"[{body}]")


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    return extract_all(text, f"[^{C.WS}]+")


def collapse_ws(text: Column) -> Column:
    """White space as single spaces, none at the ends; most texts have no other and are only trimmed."""
    other = F.contains(text, F.lit("  ")) | text.rlike(f"[{C.JAVA_WS}&&[^ ]]")
    return F.when(other, F.trim(F.regexp_replace(text, f"{C.JAVA_WS}+", " "))).otherwise(F.trim(text))


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{C.WS}]+|[{C.WS}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{C.WS}]")


def thousandths(value: Column) -> Column:
    """Rounded half up to an integer number of thousandths; engines disagree on decimal rounding."""
    return F.floor(value * 1000 + F.lit(0.5)).cast("long")


# scripts ------------------------------------------------------------------


def arabic_letters(text: Column) -> Column:
    return count_class(text, C.JAVA_AL)


def latin_letters(text: Column) -> Column:
    return count_class(text, C.JAVA_LA)


def digits(text: Column) -> Column:
    return count_class(text, C.ND)


def classify(arabic: Column, latin: Column, n_digits: Column) -> Column:
    return (
        F.when((arabic > 0) & (latin > 0), "Mixed").when(arabic > 0, "Arabic").when(latin > 0, "Latin").when(n_digits > 0, "Numeric").otherwise("Neutral")
    )


def script_class(text: Column) -> Column:
    a, la = has_class(text, C.JAVA_AL), has_class(text, C.LA)
    return F.when(a & la, "Mixed").when(a, "Arabic").when(la, "Latin").when(has_class(text, C.ND), "Numeric").otherwise("Neutral")


def direction(text: Column) -> Column:
    """rtl or ltr by the first strong letter, else null."""
    first = F.regexp_extract(text, f"[{C.JAVA_AL}{C.LA}]", 0)
    return F.when(first == "", None).when(first.rlike(f"[{C.JAVA_AL}]"), "rtl").otherwise("ltr")


def dominant_script(text: Column) -> Column:
    """The script class, with Mixed resolved to the side that has more letters (Latin if even)."""
    a, la = arabic_letters(text), latin_letters(text)
    return F.when((a > 0) & (la > 0), F.when(a > la, "Arabic").otherwise("Latin")).otherwise(script_class(text))


#: A noncharacter, put where a text is to be cut.
_CUT = "\ufdd0"


def _cut_between(text: Column, first: str, second: str) -> Column:
    return F.regexp_replace(text, f"({first})(?={second})", f"$1{_CUT}")


def script_runs(text: Column) -> Column:
    """Runs of one script; neutral characters go to the next run, at the end to the last."""
    n = f"[^{C.JAVA_AL}{C.LA}]*"
    cut = _cut_between(_cut_between(text, f"[{C.JAVA_AL}]", f"{n}[{C.LA}]"), f"[{C.LA}]", f"{n}[{C.JAVA_AL}]")
    return F.filter(F.split(cut, _CUT), lambda r: r != "")


def edited_runs(text: Column) -> Column:
    """Runs of an edited text, in which marks stay with the run before them; a text that is not Mixed is one run."""
    n, p = f"[^{C.JAVA_AL}{C.LA}]*", f"[^{C.JAVA_AL}{C.LA}{C.MK}]*"
    cut = _cut_between(text, f"[{C.JAVA_AL}](?:{n}[{C.MK}])?", f"{p}[{C.LA}]")
    cut = _cut_between(cut, f"[{C.LA}](?:{n}[{C.MK}])?", f"{p}[{C.JAVA_AL}]")
    return F.when(script_class(text) == "Mixed", F.split(cut, _CUT)).otherwise(F.array(text))


# language -----------------------------------------------------------------


def _hits(words: Column, markers: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*markers)))


def language_parts(text: Column) -> dict[str, Column]:
    """Whether a stripped text is Arabic by its letters, its script, and its words without punctuation at their ends."""
    words = F.transform(tokens(text), lambda w: F.lower(F.regexp_replace(w, f"^{C.EDGE_PUNCTUATION}|{C.EDGE_PUNCTUATION}$", "")))
    return {"script": script_class(text), "mostly": count_class(text, C.AB) > F.floor(F.length(text) / 2), "words": words}


def language_of(parts: dict[str, Column], ind: Column, eng: Column) -> tuple[Column, Column]:
    arabic, mixed = (parts["script"] == "Arabic") | parts["mostly"], parts["script"] == "Mixed"
    label = F.when(arabic, "ar").when(mixed, F.when(ind >= eng, "id").otherwise("en")).when(ind > eng, "id").when(eng > ind, "en").otherwise("unknown")
    hits = F.when(arabic, 0).when(mixed, F.greatest(ind, eng)).when(ind != eng, F.greatest(ind, eng)).otherwise(0)
    return label, hits


def language(text: Column) -> tuple[Column, Column]:
    """(label, marker hits): Arabic by script, Indonesian or English by function words, else unknown."""
    parts = language_parts(strip_ws(text))
    return language_of(parts, _hits(parts["words"], C.INDONESIAN), _hits(parts["words"], C.ENGLISH))


def with_language(frame: DataFrame, text: str = "t") -> DataFrame:
    """``frame`` with lang and hits; every part is computed once, in a projection of its own."""
    frame = frame.withColumn("_s", strip_ws(F.col(text)))
    frame = frame.withColumns({f"_{k}": v for k, v in language_parts(F.col("_s")).items()})
    frame = frame.withColumns({"_ind": _hits(F.col("_words"), C.INDONESIAN), "_eng": _hits(F.col("_words"), C.ENGLISH)})
    label, hits = language_of({k: F.col(f"_{k}") for k in ("script", "mostly")}, F.col("_ind"), F.col("_eng"))
    return frame.withColumns({"lang": label, "hits": hits}).drop("_s", "_script", "_mostly", "_words", "_ind", "_eng")


# Arabic diagnostics ---------------------------------------------------------


def isolation_flags(text: Column) -> Column:
    """A string with 1 for each token that is one Arabic letter with marks at most, else 0."""
    return lone_flags(tokens(text))


def lone_flags(words: Column) -> Column:
    lone = f"^[{C.MK}]*[{C.JAVA_AL}][{C.MK}]*$"
    return F.concat_ws("", F.transform(words, lambda k: F.when(k.rlike(lone), "1").otherwise("0")))


def is_spaced(text: Column) -> Column:
    """Whether three isolated tokens follow each other, which is to say that :func:`longest_isolated` is 3 or more."""
    lone = f"[{C.MK}]*+[{C.JAVA_AL}][{C.MK}]*+"
    return text.rlike(rf"(?:\A|{C.JAVA_WS}){lone}{C.JAVA_WS}++{lone}{C.JAVA_WS}++{lone}(?:{C.JAVA_WS}|\z)")


def spacing(text: Column) -> dict[str, Column]:
    flags = isolation_flags(text)
    runs = extract_all(flags, "1+")
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    return {"suspicious": longest >= 3, "runs": F.size(runs), "longest_run": longest, "isolated_tokens": F.length(F.replace(flags, F.lit("0"), F.lit("")))}


def marks(text: Column) -> dict[str, Column]:
    return {
        "combining_marks": count_class(text, C.MK),
        "harakat": count_class(text, C.HARAKAT),
        "shadda": F.length(text) - F.length(F.replace(text, F.lit(C.SHADDA), F.lit(""))),
        "quranic_annotations": count_class(text, C.QURANIC),
        "orphans": F.regexp_count(text, F.lit(rf"(?:\A|[{C.WS}])[{C.MK}]")),
    }


def mark_initial(text: Column) -> tuple[Column, Column]:
    """(words that begin with a vowel mark, words with an Arabic character)."""
    words = F.filter(tokens(text), lambda w: w.rlike(f"[{C.AB}]"))
    return F.size(F.filter(words, lambda w: w.rlike(f"^[{C.HARAKAT}]"))), F.size(words)


def unusual_letters(text: Column) -> Column:
    """Letters that are neither Arabic nor Latin."""
    return F.length(F.regexp_replace(text, rf"[\P{{L}}{C.AB}{C.LA}]+", ""))


def letters(text: Column) -> Column:
    return count_class(text, C.JAVA_LT)


def lines(text: Column) -> Column:
    return F.split(text, rf"\r\n|[{C.LB}]")


def punctuation_jumps(text: Column) -> Column:
    """Numbers (from 1) of lines that begin with sentence punctuation and have no letters."""
    def jumps(line: Column, k: Column) -> Column:
        return F.when(line.rlike(rf"\A[{C.WS}]*[.،؛؟۔:!?]") & ~has_class(line, C.JAVA_AL + C.LA), k + 1)

    return F.array_compact(F.transform(lines(text), jumps))


def digit_punctuation(text: Column) -> Column:
    """Places where a digit and Arabic punctuation touch, in either order."""
    d, p = f"[{C.DIGITS}]", f"[{C.ARABIC_PUNCTUATION}]"
    return F.regexp_count(text, F.lit(d + p)) + F.regexp_count(text, F.lit(p + d))


def longest_isolated(text: Column) -> Column:
    """The longest run of isolated tokens; tokens are listed only if one of them is isolated."""
    lone = rf"(?<![^{C.WS}])[{C.MK}]*+[{C.JAVA_AL}][{C.MK}]*+(?![^{C.WS}])"
    return F.when(~text.rlike(lone), 0).otherwise(F.coalesce(F.array_max(F.transform(extract_all(isolation_flags(text), "1+"), F.length)), F.lit(0)))


def count_jumps(text: Column) -> Column:
    """How many lines :func:`punctuation_jumps` lists; lines are parted only if one begins so."""
    starts = rf"(?:\A|[{C.LB}])[{C.WS}&&[^{C.LB}]]*+[.،؛؟۔:!?]"
    return F.when(~text.rlike(starts), 0).otherwise(F.size(punctuation_jumps(text)))


def integrity_counts(text: Column) -> dict[str, Column]:
    """What the score is made of; words are tokens with an Arabic character."""
    begin = f"(?<![^{C.WS}])"
    return {
        "n_letters": letters(text),
        "n_forms": count_class(text, C.PF),
        "n_unusual": unusual_letters(text),
        "longest": longest_isolated(text),
        "n_orphans": F.regexp_count(text, F.lit(rf"(?:\A|[{C.WS}])[{C.MK}]")),
        "n_initial": F.regexp_count(text, F.lit(f"{begin}[{C.HARAKAT}]")),
        "n_words": F.regexp_count(text, F.lit(f"{begin}[^{C.WS}{C.AB}]*+[{C.AB}]")),
        "n_jumps": count_jumps(text),
        "arabic": has_class(text, C.JAVA_AL),
    }


def integrity(text: Column, severe: Column | None = None) -> dict[str, Column]:
    """Penalties (as doubles), score and level; null for text without Arabic letters. severe: number of severe bidi issues."""
    return penalties(integrity_counts(text), severe)


def needed_counts(frame: DataFrame, text: str) -> DataFrame:
    """``frame`` with counts that give the penalties of :func:`integrity_counts`: letters where there are forms, words where one begins with a vowel mark, and three isolated tokens for three or more."""
    t = F.col(text)
    counts = {k: v for k, v in integrity_counts(t).items() if k not in ("n_letters", "longest", "n_words")}
    counts["n_initial"] = F.regexp_count(t, F.lit(f"[{C.HARAKAT}](?<![^{C.WS}][{C.HARAKAT}])"))
    frame = frame.withColumns(counts)
    every = integrity_counts(t)
    return frame.withColumns({"n_letters": F.when(F.col("n_forms") > 0, every["n_letters"]).otherwise(0), "longest": F.when(is_spaced(t), 3).otherwise(0), "n_words": F.when(F.col("n_initial") > 0, every["n_words"]).otherwise(0)})


def with_penalties(frame: DataFrame, text: str = "t") -> DataFrame:
    """``frame`` with the penalties and score of :func:`with_integrity`, from the counts that these need."""
    counts = integrity_counts(F.col(text))
    frame = needed_counts(frame, text).withColumn("rate", _rate({k: F.col(k) for k in counts}))
    return frame.withColumns(penalties({k: F.col(k) for k in [*counts, "rate"]}))


def with_integrity(frame: DataFrame, text: str = "t") -> DataFrame:
    """``frame`` with the counts, penalties and score; every count is computed once, in a projection of its own."""
    counts = integrity_counts(F.col(text))
    frame = frame.withColumns(counts)
    frame = frame.withColumn("rate", _rate({k: F.col(k) for k in counts}))
    return frame.withColumns(penalties({k: F.col(k) for k in [*counts, "rate"]}))


def _rate(c: dict[str, Column]) -> Column:
    return F.when(c["n_words"] > 0, c["n_initial"] / c["n_words"]).otherwise(0.0)


def penalties(c: dict[str, Column], severe: Column | None = None) -> dict[str, Column]:
    forms = F.when(c["n_letters"] > 0, F.least(F.lit(0.25), c["n_forms"] / c["n_letters"] * 0.4)).otherwise(0.0)
    unusual = F.least(F.lit(0.3), c["n_unusual"] * 0.05)
    spaced = F.when(c["longest"] >= 3, 0.25).otherwise(0.0)
    orphans = F.least(F.lit(0.2), c["n_orphans"] * 0.05)
    rate = c.get("rate", _rate(c))
    reversal = F.when(rate >= 0.2, F.least(F.lit(0.45), F.greatest(F.lit(0.3), rate * 0.6))).otherwise(0.0)
    if severe is None:
        severe = F.when(c["n_jumps"] > 0, 1).otherwise(0)
    total = F.lit(1.0) - forms - unusual - spaced - orphans - reversal - severe * 0.1
    score = F.when(c["arabic"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return {"forms": forms, "unusual": unusual, "spaced": spaced, "orphans": orphans, "reversal": reversal, "score": score}


def integrity_level(score: Column) -> Column:
    return F.when(score >= 0.85, "good").when(score >= 0.6, "review_recommended").when(score.isNotNull(), "problem_likely")


def may_be_problem(text: Column) -> Column:
    """False if no text made of these characters (and of others that are neither letters beyond Latin nor marks) scores below 0.6.

    Without presentation forms, unusual letters and marks, only spacing (0.25) and a jump (0.1) can be taken off; without Arabic letters there is no score.
    """
    return text.rlike(rf"\A(?=[^{C.JAVA_SUSPECT}]*+[{C.JAVA_SUSPECT}])[^{C.JAVA_AL}]*+[{C.JAVA_AL}]")


# paragraphs -----------------------------------------------------------------


def ends_terminal(text: Column) -> Column:
    return text.rlike(rf"[{C.TERMINAL}][{C.WS}]*\z")


def starts_no_space(text: Column) -> Column:
    return text.rlike(rf"\A[{C.NO_SPACE}]")


# markup -----------------------------------------------------------------------


def xml_text(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{C.XML_LEGAL}]", "")


def escape(text: Column) -> Column:
    out = xml_text(text)
    for a, b in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def quoteattr(text: Column) -> Column:
    out = escape(text)
    for a, b in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    double, single = F.contains(out, F.lit('"')), F.contains(out, F.lit("'"))
    return (
        F.when(double & single, F.concat(F.lit('"'), F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit('"')))
        .when(double, F.concat(F.lit("'"), out, F.lit("'")))
        .otherwise(F.concat(F.lit('"'), out, F.lit('"')))
    )


def attrs(lang: Column, dir_: Column, css: Column | None = None) -> Column:
    parts = [] if css is None else [F.when(css.isNotNull(), F.concat(F.lit(' class="'), css, F.lit('"')))]
    parts.append(F.when(lang.isNotNull() & (lang != "") & (lang != "unknown"), F.concat(F.lit(' lang="'), escape(lang), F.lit('"'))))
    parts.append(F.when(dir_.isNotNull(), F.concat(F.lit(' dir="'), dir_, F.lit('"'))))
    return F.concat_ws("", *parts)


def edge_space(text: Column) -> tuple[Column, Column, Column]:
    """(leading white space, content, trailing white space); all of a blank text is leading."""
    before = F.regexp_extract(text, rf"\A[{C.WS}]*", 0)
    rest = F.substr(text, F.length(before) + 1)
    after = F.regexp_extract(rest, rf"[{C.WS}]*\z", 0)
    return before, F.substr(rest, F.lit(1), F.length(rest) - F.length(after)), after


def bdi(text: Column, lang: Column, dir_: Column) -> Column:
    """A span isolated for bidirectional text; its outer white space stays outside."""
    before, content, after = edge_space(text)
    return F.concat(escape(before), F.lit("<bdi"), attrs(lang, dir_), F.lit(">"), escape(content), F.lit("</bdi>"), escape(after))


# names and messages -------------------------------------------------------------


def sanitize_filename(name: Column) -> Column:
    base = F.regexp_extract(F.coalesce(name, F.lit("document.pdf")), r"([^/]*)/*\z", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"\A[._]+|[._]+\z", "")
    return F.substring(F.when(clean == "", "document.pdf").otherwise(clean), 1, 120)


def split_authors(text: Column, most: int = 5) -> Column:
    parts = F.transform(F.split(text, r"[,&]|\band\b"), strip_ws)
    return F.slice(F.filter(parts, lambda p: p != ""), 1, most)


def format_bytes(n: Column) -> Column:
    tenths = F.floor(n / 1048576 * 10 + 0.5)
    mb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))
    return F.when(n >= 1048576, mb).otherwise(F.concat(F.greatest(F.lit(1), F.floor(n / 1024 + 0.5)).cast("string"), F.lit(" KB")))


OCR_LANGUAGES = {"ar": "ara", "ara": "ara", "id": "ind", "ind": "ind", "en": "eng", "eng": "eng"}


def language_codes(langs: Column) -> Column:
    """Recognizer codes, first occurrences only; an unknown language is an error."""
    def code(lang: Column) -> Column:
        out = F.raise_error(F.concat(F.lit("unsupported OCR language: "), lang)).cast("string")
        for k, v in OCR_LANGUAGES.items():
            out = F.when(lang == k, v).otherwise(out)
        return out

    return F.array_distinct(F.transform(langs, code))


def printed_page_number(text: Column) -> Column:
    folded = F.translate(text, C.ARABIC_INDIC, "0123456789")
    plain, labeled = F.regexp_extract(folded, C.PAGE_NUMBER, 1), F.regexp_extract(folded, C.LABELED_PAGE, 1)
    return F.when(plain != "", plain.cast("int")).when(labeled != "", labeled.cast("int"))


def repetition_key(text: Column) -> Column:
    folded = collapse_ws(F.translate(text, C.ARABIC_INDIC, "0123456789"))
    return F.replace(F.lower(F.regexp_replace(folded, r"\d+", "#")), F.lit("ß"), F.lit("ss"))
