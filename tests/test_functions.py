"""Known inputs and results of the text functions and page operators."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmill.functions import chars as C
from quillmill.functions import text as T
from quillmill.operators import furniture as U
from quillmill.operators import geometry as G
from quillmill.operators import structure as S


def one(spark, text, *columns):
    row = spark.createDataFrame([(text,)], "t string").select(*columns).first()
    return row[0] if len(row) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("text", "script"),
    [("بسم الله الرحمن الرحيم", "Arabic"), ("Teks 123", "Latin"), ("12345", "Numeric"), ("١٤٤٧", "Numeric"), ("؟!.,؛«»", "Neutral"), ("", "Neutral"), ("Hadits dari أبي هريرة dalam Shahih.", "Mixed")],
)
def test_script_class(spark, text, script):
    assert one(spark, text, T.script_class(F.col("t"))) == script


@pytest.mark.parametrize(("text", "dir_"), [("123 أبي هريرة", "rtl"), ("123 abc", "ltr"), ("12345", None)])
def test_direction(spark, text, dir_):
    assert one(spark, text, T.direction(F.col("t"))) == dir_


def test_spacing(spark):
    s = T.spacing(F.col("t"))
    assert one(spark, "ا ل س ل ا م عليكم", s["suspicious"], s["longest_run"], s["isolated_tokens"]) == (True, 6, 6)
    assert one(spark, "ا ل bismillah", s["suspicious"]) is False


def test_marks(spark):
    m = T.marks(F.col("t"))
    assert one(spark, "بِسْمِ", m["harakat"]) == 3
    assert one(spark, "السلام َعليكم", m["orphans"]) == 1


def test_integrity_levels(spark):
    score = T.integrity(F.col("t"))["score"]
    assert one(spark, "ِتاَّيِّنلاِب ُلاَمْعَأْلا اَمَّنِإ", T.integrity_level(score)) == "problem_likely"
    assert one(spark, "قَالَ ۖ وَقَالَ ۚ رَسُولُ اللَّهِ ۘ", T.mark_initial(F.col("t"))[0]) == 0
    assert one(spark, "ا ل س ل ا م სტ სტ", T.integrity_level(score)) == "problem_likely"
    assert one(spark, "plain text", score) is None


@pytest.mark.parametrize("text", ["xyzzy quux", "12345", ""])
def test_unknown_language(spark, text):
    assert one(spark, text, T.language(F.col("t"))[0]) == "unknown"


def test_printed_page_numbers(spark):
    assert [one(spark, t, T.printed_page_number(F.col("t"))) for t in ("- 7 -", "Halaman 12", "٣", "chapter 7 ends")] == [7, 12, 3, None]


def split_runs(text: str, marks_stay: bool) -> list[str]:
    """Brute force: neutral characters wait for the next letter; marks may go to the run before."""
    def kind(c):
        if any(a <= ord(c) <= b for a, b in T.C.ARABIC_BLOCKS) and unicodedata.category(c)[0] == "L":
            return "A"
        return "L" if any(a <= ord(c) <= b for a, b in T.C.LATIN_BLOCKS) else None

    runs, wait = [], ""
    for c in text:
        k = kind(c)
        if k is None:
            if marks_stay and runs and unicodedata.category(c)[0] == "M":
                runs[-1][1] += wait + c
                wait = ""
            else:
                wait += c
        elif runs and runs[-1][0] == k:
            runs[-1][1] += wait + c
            wait = ""
        else:
            runs.append([k, wait + c])
            wait = ""
    if wait and runs:
        runs[-1][1] += wait
    elif wait:
        runs.append([None, wait])
    return [r for _, r in runs]


def test_run_splitters_match_brute_force(spark):
    import random

    random.seed(3)
    alphabet = list("ab 1,.é") + list("اب َّ،") + ["̀", "\n"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 14))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, script, runs, edited in frame.select("t", T.script_class(F.col("t")), T.script_runs(F.col("t")), T.edited_runs(F.col("t"))).collect():
        assert runs == split_runs(t, False)
        assert edited == (split_runs(t, True) if script == "Mixed" else [t])


def test_gutters(spark):
    grid = [(1, 1, float(x0), float(x1)) for x0, x1 in ((50, 200), (230, 380), (410, 560)) for _ in range(3)]
    blocks = spark.createDataFrame(grid + [(2, 1, 50.0, 500.0)] * 5, "doc_id long, page int, x0 double, x1 double")
    found = {r["doc_id"]: r["gutters"] for r in G.find_gutters(blocks, 595.0).collect()}
    a, b = found[1]
    assert 200 < a < 230 and 380 < b < 410 and found[2] == []


def test_right_to_left_columns(spark):
    boxes = [(1, 1, k, "نص", x0, 100.0 + 100 * r, x0 + 150, 150.0 + 100 * r) for k, (c, r) in enumerate((c, r) for c in range(3) for r in range(3)) for x0 in [(50.0, 230.0, 410.0)[c]]]
    blocks = spark.createDataFrame(boxes, "doc_id long, page int, block_no int, text string, x0 double, y0 double, x1 double, y1 double")
    gutters = spark.createDataFrame([(1, 1, [215.0, 395.0])], "doc_id long, page int, gutters array<double>")
    order = [r["block_no"] for r in G.reading_order(blocks, gutters).orderBy("ord").collect()]
    assert order == [6, 7, 8, 3, 4, 5, 0, 1, 2]


def test_furniture(spark):
    rows = [(1, p, 0, "Kitab Niat", 50.0, 20.0, 300.0, 40.0) for p in (1, 2, 3)] + [(1, p, 1, str(p), 290.0, 800.0, 300.0, 820.0) for p in (1, 2, 3)] + [(1, 1, 2, "Isi buku ini", 50.0, 300.0, 500.0, 320.0)]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, block_no int, text string, x0 double, y0 double, x1 double, y1 double")
    found = {(r["page"], r["block_no"]): (r["kind"], r["printed"]) for r in U.furniture(blocks, 842.0).collect()}
    assert found == {(p, 0): ("header", None) for p in (1, 2, 3)} | {(p, 1): ("page_number", p) for p in (1, 2, 3)}
    assert [r["block_no"] for r in U.without_furniture(blocks, 842.0).collect()] == [2]


def page(spark, rows):
    schema = "doc_id long, page int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, flags int"
    return spark.createDataFrame([(1, 1, k, *r) for k, r in enumerate(rows)], schema)


def test_headings(spark):
    body = [("isi " * 60, 72.0, 100.0 + 50 * k, 520.0, 140.0 + 50 * k, 11.0, 0) for k in range(3)]
    rows = page(spark, [("Judul Buku", 72.0, 50.0, 300.0, 80.0, 18.0, 16), ("Bab Pertama: Niat", 72.0, 300.0, 300.0, 320.0, 11.0, 0), *body])
    levels = {r["block_no"]: r["level"] for r in S.with_headings(S.with_body_size(rows)).filter("level is not null").collect()}
    assert levels == {0: 1, 1: 1}


def test_paragraphs_merge_and_fragments_join(spark):
    rows = page(spark, [("satu dua tiga", 72.0, 100.0, 520.0, 120.0, 11.0, 0), ("empat lima.", 72.0, 130.0, 300.0, 150.0, 11.0, 0), ("أما بعد", 72.0, 160.0, 200.0, 180.0, 11.0, 0), (":", 72.0, 190.0, 80.0, 210.0, 11.0, 0)])
    rows = S.with_headings(S.with_reference_width(S.with_body_size(rows))).withColumn("marker", F.lit(None).cast("string")).withColumn("ord", F.col("block_no"))
    found = [(r["text"], r["n_blocks"], r["confidence"]) for r in S.paragraph_flow(rows).orderBy("para").collect()]
    assert found == [("satu dua tiga empat lima.", 2, 0.75), ("أما بعد:", 2, 0.95)]


def test_table_needs_rules(spark):
    cells = [(1, 1, r, c, f"{r}{c}", 60.0 + 150 * c, 100.0 + 40 * r, 160.0 + 150 * c, 120.0 + 40 * r) for r in range(3) for c in range(3)]
    lines = "doc_id long, page int, block_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double"
    rules = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double"
    rule = spark.createDataFrame([(1, 1, 60.0, 150.0, 460.0, 151.0)], rules)
    assert S.tables(spark.createDataFrame(cells, lines), spark.createDataFrame([], rules)).count() == 0
    grid = S.tables(spark.createDataFrame(cells, lines), rule).collect()
    assert {(r["row"], r["col"], r["text"], r["confidence"]) for r in grid} == {(r, c, f"{r}{c}", 0.9) for r in range(3) for c in range(3)}
    twice = cells + [(*cells[0][:2], 9, 9, *cells[0][4:])]
    assert S.tables(spark.createDataFrame(twice, lines), rule).count() == 0
    gap = [c for k, c in enumerate(cells) if k != 4]
    assert {r["confidence"] for r in S.tables(spark.createDataFrame(gap, lines), rule).collect()} == {0.9}
    assert S.tables(spark.createDataFrame(cells[:3], lines), rule).count() == 0


def slow_clusters(values, tolerance):
    """Ascending values, each in the cluster before it if it is near that cluster's mean."""
    ids, members = [], []
    for v in sorted(values):
        if members and v - sum(members) / len(members) <= tolerance:
            members.append(v)
        else:
            members = [v]
        ids.append((ids[-1] if ids else 0) + (len(members) == 1))
    return ids


def test_cluster_fold_matches_loop(spark):
    import random

    random.seed(5)
    for _ in range(20):
        values = [random.uniform(0, 60) for _ in range(random.randint(1, 12))]
        want = slow_clusters(values, 6.0)
        frame = spark.createDataFrame([(values,)], "v array<double>")
        assert frame.select(G.cluster_ids(F.col("v"), 6.0)).first()[0] == want


def test_character_counts_list_no_matches_and_take_every_character(spark):
    every = "".join(chr(c) for c in range(1, 0x3000)) + "".join(chr(c) for c in range(0xFB00, 0x10000)) + "😀𞤀"
    rows = spark.createDataFrame([(every,), ("",), (None,)], "t string")
    t = F.col("t")
    for body, count in ((C.AL, T.arabic_letters(t)), (C.LT, T.letters(t)), (C.LA, T.latin_letters(t)), (C.MK, T.count_class(t, C.MK)), (f"\\p{{L}}&&[^{C.AB}{C.LA}]", T.unusual_letters(t))):
        got = rows.select(count.alias("n"))
        assert "extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert [r[0] for r in got.collect()] == [r[0] for r in rows.select(F.regexp_count(t, F.lit(f"[{body}]"))).collect()]


def test_integrity_counts_equal_those_by_token(spark):
    texts = ["ا ل س ل ا م كتاب", "اَ بَّ ت x", " َت كتاب ًا a1", "x" * 3000 + "ا", "abc\n ؟\r\n.، \n\n!ا", "", None, "ا " * 4000]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    t = F.col("t")
    initial, words = T.mark_initial(t)
    want = rows.select("k", T.spacing(t)["longest_run"], initial, words, F.size(T.punctuation_jumps(t))).orderBy("k").collect()
    got = T.with_integrity(rows).select("k", "longest", "n_initial", "n_words", "n_jumps").orderBy("k").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
