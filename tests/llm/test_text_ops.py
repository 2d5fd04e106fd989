"""Language identification, secrets, HTML extraction, licences, mixing and packing."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import html_extract, langid, licenses, mixing, packing, secrets
from quillmill.llm.html_extract import extract, hash_of, main_text, parse, walk
from quillmill.llm.mixing import mix, source_targets
from quillmill.llm.queries import held_out, queries, vocabulary_path
from quillmill.llm.tokens import WordTokenizer
from tests.llm.conftest import PROSE, awkward

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return langid.train_on(docs, ~held_out(), max_docs_per_lang=60)


def test_language_accuracy_held_out(spark, model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter(held_out())
    rows = langid.identify(docs, model).select("lang", "lang_pred", "score", "rejected").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert np.mean([r["rejected"] for r in rows]) < 0.02
    sure = [r for r in rows if r["score"] > 0.9]
    assert np.mean([r["lang"] == r["lang_pred"] for r in sure]) > 0.99


def test_language_of_awkward_texts(docs, no_docs, model):
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        unknown = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == unknown and 0 <= r["score"] <= 1
        assert not unknown or (r["score"] == 0 and r["rejected"])
    assert langid.identify(no_docs, model).count() == 0
    assert langid.train([]).predict("text") == ("und", 0.0, True)


def test_long_text_scores_like_its_parts_together(model):
    rng = random.Random(1)
    words = " ".join(rng.choice(PROSE) for _ in range(200_000))
    ids = langid.features(langid.letter_codes(words))
    whole = model.table[ids].sum(axis=0, dtype=np.float64) / np.count_nonzero(ids) + model.bias
    assert np.allclose(model.logits(words), whole, atol=1e-2)


def slow_spans(text):
    text = text or ""
    out = []
    for kind, pattern, ok in (
        (0, re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
        (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m)]
    return sorted(out)


def test_base_spans_match_brute_force():
    rng = random.Random(11)
    bits = ["token", "API_KEY", "apikey", "ſecret", "secret", "Password", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "ABCDEFGH1234", "zz", "é", "\n", "aaaa.bbbb-cccc"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == slow_spans(text)


def test_secrets(spark, docs, no_docs):
    rng = random.Random(5)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44))
    words = "overthemountain2024andthroughthevalley"
    rows = [(1, f"see {key} and {words} here"), (2, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (3, "a" * 30 + "1" * 30), (4, None)]
    got = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["spans"] == f"random:4:{4 + len(key)}" and got[1]["n_random"] == 1
    assert (got[2]["n_assign"], got[2]["n_hex"], got[2]["n_random"]) == (1, 1, 0)
    assert got[2]["spans"] == "assign:0:49,hex:9:49"
    assert got[3]["n_random"] == 0 and got[4]["spans"] == ""
    assert secrets.find_secrets(docs).count() == len(awkward()) and secrets.find_secrets(no_docs).count() == 0


def slow_random_spans(texts, rate=0.01):
    """Spans that both steps of Benjamini-Hochberg let through, over sorted lists of p-values."""
    found: dict = {}
    for k, text in enumerate(texts):
        for a, b, group, bin_, fit in secrets.candidates(text):
            found.setdefault(group, []).append((k, a, b, math.exp(-bin_), math.exp(-fit / secrets.FINE)))

    def rejected(ps):
        ranked = sorted(ps)
        return max((p for i, p in enumerate(ranked, 1) if p <= rate * i / len(ranked)), default=-1.0)

    out = set()
    for rows in found.values():
        written, fit = rejected([r[3] for r in rows]), rejected([r[4] for r in rows])
        out |= {r[:3] for r in rows if r[3] <= written and r[4] > fit}
    return out


def test_random_spans_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(150):
        parts = [" ".join(rng.choice(PROSE) for _ in range(5))]
        for _ in range(rng.randrange(4)):
            alphabet = rng.choice(secrets.ALPHABETS[2:])
            parts.append(rng.choice(["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 90))), "".join(rng.choice(PROSE) for _ in range(6)) + "2024", "ab1" * rng.randrange(7, 30)]))
        texts.append(" ".join(parts))
    texts.append("x1y2z3" * 100_000)  # a very long token is one like any other
    found = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {(r["doc_id"], *map(int, s.split(":")[1:])) for r in found for s in r["spans"].split(",") if s.startswith("random")}
    base = {(k, a, b) for k, t in enumerate(texts) for a, _, b in secrets.base_spans(t)}
    want = {x for x in slow_random_spans(texts) if not any(k == x[0] and a <= x[1] and x[2] <= b for k, a, b in base)}
    assert got == want and 50 < len(got) < 250


def test_random_tokens_pass_the_battery_and_false_ones_are_few():
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(500)]
    assert np.mean([secrets.p_random(h, secrets.ALPHABETS[0]) < 0.01 for h in hexes]) < 0.05
    assert secrets.p_random("0123456789abcdef" * 3, secrets.ALPHABETS[0]) < 0.01
    assert secrets.bh_bins({0: 1000}, 0.01) == secrets.BINS + 1 and secrets.bh_bins({0: 90, 40: 10}, 0.01) == 40


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<nav>menu</nav><article><h1>A&nbsp; b</h1><p>one<br>two <i>th</i>ree<p>four</article><footer>f</footer>", "A b\none two three\nfour"),
        ("<body><header>Site</header><div class='sidebar'>x</div><div><p>body &lt;3</p></div><form>q</form><div id=comments><p>nice</p></div></body>", "body <3"),
        ("<article><p>a</p><script>var x='</p><p>no';</script><style>p{}</style><!-- <p>c</p> --><p>b</p><div class=ad>buy</div></article>", "a\nb"),
        ("<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>", "one\ntwo\nc1\nc2"),
        ("<p>un<b>closed", "unclosed"),
        ("<main><article><p>x</p></article><article><p>y</p></article><p>z</p></main>", "x\ny"),
        ("<div class='layout has-sidebar'><article><p>kept</p></article><div class='sidebar'>x</div></div>", "kept"),
        ("<form id='aspnetForm'><div><article><h1>T</h1><p>kept</p></article><form>q</form></div></form>", "T\nkept"),
        ("<body><form id='page'><div class='nav-bar'>menu</div><h1>T</h1><p>kept</p></form></body>", "T\nkept"),
        ("<div class='promo-free content'><p>kept</p></div>", "kept"),
        ("<div class='sidebar'><article><p>kept</p></article></div>", "kept"),
        ("<div class='sidebar'><article>teaser</article></div><article><p>kept</p></article>", "kept"),
        ("<aside><article>teaser</article></aside><p>kept</p>", "kept"),
        ("<article><p>a</p><div class='share-price table'>12 up</div><div class='social-share'>tell</div><div class='comments-area'>hm</div></article>", "a\n12 up"),
        ("<body><div><a href=1>one</a> <a href=2>two</a> | <a href=3>three</a></div><div><p>kept <a href=4>this</a> text</p></div></body>", "kept this text"),
        ("<body><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></body>", "one\ntwo\nthree"),
        ("<article><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>", "one\ntwo\nthree"),
    ],
)
def test_extract(html, text):
    assert extract(html) == text


def test_deep_markup():
    assert extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_very_long_and_repeated_pages(spark):
    long = " ".join(["word &amp; more"] * 200_000)
    rows = [(1, "https://h.example/1", f"<nav>m</nav><article><p>{long}</p></article>")] * 2 + [(None, "https://h.example/2", "<p>x</p>")]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["n_chars"] for r in got) == [1] + [len(long.replace("&amp;", "&"))] * 2


def slow_low(pages, least=2, threshold=0.3, gamma=0.9):
    """Per host the low (path, text) branches, by counting every place's styles and texts one by one."""
    places: dict = {}
    for host, html in pages:
        seen: Counter = Counter()
        for node in walk(parse(html)):
            if node.tag in html_extract.CONTAINERS and not node.dropped(False) and not html_extract.holds_main(node):
                style, content = tuple(k.tag for k in node.kids if not isinstance(k, str)), tuple(html_extract.blocks(node, frozenset()))
                places.setdefault((host, node.path, seen[node.path]), []).append((style, content))
                seen[node.path] += 1

    def entropy(values):
        m = len(values)
        return -sum(n / m * math.log(n / m) for n in Counter(values).values()) / math.log(max(m, 2))

    low = set()
    for (host, path, _), values in places.items():
        if len(values) >= least and (1 - gamma) * entropy([v[0] for v in values]) + gamma * entropy([v[1] for v in values]) < threshold:
            low |= {(host, path, c) for c, n in Counter(v[1] for v in values).items() if n > 1}
    return low


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_style_tree_equals_brute_force(spark, n):
    rng = random.Random(n)
    pages = []
    for k in range(n):
        parts = ["<div class='hello'>Welcome to all of you</div>", f"<div class='tip'>Tip {rng.randrange(1 + n // 8)} of the day</div>", f"<div><p>story {k} of {rng.random()}</p><ul><li>same item</ul></div>"]
        pages.append(("h.example", "<body>" + "".join(parts if rng.random() < 0.9 else parts[1:]) + "</body>"))
    table = spark.createDataFrame([(k, f"http://{h}/{k}", t) for k, (h, t) in enumerate(pages)], "page_id long, url string, html string")
    got = {h for r in html_extract.low_branches(html_extract.branch_rows(table)).collect() for h in r["low"]}
    want = slow_low(pages)
    assert got == {hash_of(p) for _, p, _ in want} | {hash_of(f"{p}\n{hash_of(chr(10).join(c))}") for _, p, c in want}
    text = {r["page_id"]: r["text"] for r in main_text(table).collect()}
    assert all(("Welcome" in t) == (n == 1) and "story" in t for t in text.values())


def test_style_tree_removes_what_repeats(spark):
    pages = [(k, f"https://host.example/{k}", f"<body><div class='top'>Welcome to our site</div><div class='text'><p>story {k} about {PROSE[k]} things</p><p>more of {k}</p></div></body>") for k in range(8)]
    pages += [(100, "https://other.example/a", "<body><div class='top'>Welcome to our site</div></body>"), (101, None, None), (102, "odd url", "<p>x</p>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in main_text(table).collect()}
    assert got[3][0] == f"story 3 about {PROSE[3]} things\nmore of 3"
    assert got[100][0] == "Welcome to our site" and got[101] == ("", 0) and got[102] == ("x", 1)
    assert main_text(table.limit(0)).count() == 0


def test_unique_branches_beside_a_repeated_one_stay(spark):
    pages = [(k, f"https://host.example/{k}", f"<article><div>By the staff</div><p>opening words of story {k} that go on for a while</p><div>story {k} about {PROSE[k]}</div></article>") for k in range(8)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(table).collect()}
    assert got[3] == f"opening words of story 3 that go on for a while\nstory 3 about {PROSE[3]}"


def test_branch_with_most_of_the_text_stays():
    html = "<body><div class='text'><p>all there is</p></div></body>"
    path = next(n.path for n in walk(parse(html)) if n.tag == "div")
    assert extract(html, frozenset([hash_of(path)])) == "all there is"


def test_licenses(spark, docs, no_docs):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and t.startswith("Permission"))
    rows = [(1, "a/LICENSE", mit), (2, "a/b/code.txt", "plain words only"), (3, "a/b/c.txt", "Intro words about this and that.\nLicensed under the Apache License, Version 2.0.\nMany more words follow here, and they say nothing of it"), (4, "z/x.txt", "nothing"), (5, "a/b/d/LICENSE", "Licensed under CC BY-NC 4.0."), (6, "a/b/d/e/f.txt", None), (7, None, "q")]
    files = spark.createDataFrame(rows, "doc_id long, p string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(files, F.col("p")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: (None, "none"), 5: ("CC-BY-NC-4.0", "own"), 6: ("CC-BY-NC-4.0", "inherited"), 7: (None, "none")}
    assert licenses.scan_licenses(docs, F.col("source")).count() == len(awkward())
    assert licenses.scan_licenses(no_docs, F.col("source")).count() == 0


def test_whole_licence_files(spark):
    """Every whole licence, re-wrapped and with a holder, is a licence file, and speaks for its folder with its own path."""
    rows, want = [], {}
    for k, (name, text) in enumerate(licenses.whole_licenses()):
        rows.append((3 * k, f"{name}/COPYING", "Copyright 2020 A. Holder\n" + " ".join(text.split())))
        rows.append((3 * k + 1, f"{name}/src/a.txt", "words of no licence"))
        rows.append((3 * k + 2, f"{name}/b.txt", text[: len(text) // 50] + "\n" + "many other words " * 400))
        want |= {3 * k: (name, "own", None), 3 * k + 1: (name, "inherited", f"{name}/COPYING")}
    files = spark.createDataFrame(rows, "doc_id long, p string, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(files, F.col("p")).collect()}
    assert {k: (got[k]["license"], got[k]["origin"], got[k]["license_path"]) for k in want} == want
    assert all(got[k]["cosine"] >= 0.85 for k in want)


def test_best_licence_file_of_a_folder(spark):
    """The path that is named holds the licence that is inherited, also where the smaller path holds another."""
    text = dict(licenses.whole_licenses())
    rows = [(1, "d/A.txt", "Released under the MIT License. " + "other words here " * 3), (2, "d/B.txt", text["BSD-3-Clause"]), (3, "d/x/c.txt", "none"), (4, "d/x/y/", None), (5, "e", "none")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p")).collect()}
    assert (got[3]["license"], got[3]["license_path"]) == (got[4]["license"], got[4]["license_path"]) == ("BSD-3-Clause", "d/B.txt")
    assert got[5]["origin"] == "none"


def slow_cosines(texts, templates):
    """Cosines of dense TF-IDF vectors, word by word."""
    bags = [Counter(licenses.words(t)) for t in texts]
    known = {w for _, t in licenses.TEMPLATES + licenses.whole_licenses() for w in licenses.words(t)}
    idf = lambda w: math.log((1 + len(texts)) / (1 + sum(w in b for b in bags) if w in known else 1)) + 1

    def dense(bag, axis):
        v = np.array([(1 + math.log(bag[w])) * idf(w) if bag[w] else 0.0 for w in axis])
        return v / (np.linalg.norm(v) or 1)

    out = []
    for bag in bags:
        row = []
        for _, t in templates:
            other = Counter(licenses.words(t))
            axis = sorted(bag | other)
            row.append(float(dense(bag, axis) @ dense(other, axis)))
        out.append(row)
    return out


def test_licence_cosines_equal_brute_force(spark):
    rng = random.Random(5)
    pool = [w for _, t in licenses.TEMPLATES for w in licenses.words(t)] + ["river", "stone", "light"] * 30
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(25)] + [t for _, t in licenses.TEMPLATES[:6]]
    files = spark.createDataFrame([(t,) for t in texts], "text string")
    matcher = licenses.Matcher(*licenses.word_frequencies(files))
    for whole, templates in ((False, licenses.TEMPLATES), (True, licenses.whole_licenses()[:2])):
        for text, row in zip(texts, slow_cosines(texts, templates)):
            index = (matcher.wholes if whole else matcher.headers)[1]
            for k, want in enumerate(row):
                got = sum(x * dict(index.get(w, ())).get(k, 0.0) for w, x in matcher.vector(licenses.words(text)).items())
                assert math.isclose(got, want, abs_tol=1e-9)


def test_license_templates_find_themselves():
    matcher = licenses.Matcher({}, 10)
    for name, text in licenses.TEMPLATES:
        assert matcher.best(text)[1] == name and matcher.best(text)[0] > 0.999


def slow_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def test_targets(spark):
    rng = random.Random(7)
    for _ in range(4):
        sizes = {f"s{k}": rng.choice([0, 5, 50, 500, 5000]) for k in range(rng.randint(1, 9))} | {None: 30}
        got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = slow_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix(docs, no_docs):
    rows = [tuple(r) for r in mix(docs).collect()]
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in mix(docs.repartition(7)).collect())  # reruns agree
    assert len(rows) == len(awkward())
    assert all(0 <= taken <= 2 * size and taken % max(size, 1) == 0 for _, size, _, _, taken in rows)
    assert mix(no_docs).count() == 0


def test_mix_reaches_targets(spark):
    got = queries()["op9_mixing"](spark, DATA).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.03 * r["target"] for r in got)


def one_by_one(rows, budget, seed="mix"):
    """Ids of rows (id, size) taken in the order of keys: the prefix within the budget, then all that still fit."""
    def u(k):
        return (int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    taken, total, open_ = set(), 0, True
    for k, size in sorted(rows, key=lambda r: (-u(r[0]), r[0])):
        if total + size <= budget and (open_ or size):
            taken.add(k)
            total += size
        else:
            open_ = False
    return taken


@pytest.mark.parametrize("most", [1024, 3])
def test_all_later_documents_may_fill(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "FILL", most)
    rng = random.Random(5)
    flat = [(k, 10) for k in range(1000)]
    # one document that straddles the budget and is longer than 256 of average size
    long = next(k for k in range(1000, 2000) if 0.45 < int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:13], 16) / 2**52 < 0.55)
    mixed = [(k, rng.choice([0, 1, 3, 10, 50, 400, 2000])) for k in range(3000)]
    for rows in ([*flat, (long, 5000)], mixed):
        docs = spark.createDataFrame([(k, "w " * n, "s") for k, n in rows], "doc_id long, text string, source string")
        got = {r["doc_id"]: r["taken"] for r in mix(docs, share=0.5).collect()}
        want = one_by_one(rows, 0.5 * sum(n for _, n in rows))
        assert {k for k, n in rows if n and got[k]} == {k for k, n in rows if n and k in want}


def test_heavier_documents_come_first(spark):
    frame = spark.range(4000).selectExpr("id as doc_id", "'a b c d' as text", "'s' as source", "case when id % 2 = 0 then 4.0D else 1.0D end as w")
    other = spark.range(4000, 8000).selectExpr("id as doc_id", "'a b c d' as text", "'t' as source", "1.0D as w")
    got = mix(frame.unionByName(other), F.col("w"), weights=(1, 2), share=1.0).filter("doc_id < 4000").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg(F.col("taken") / 4).alias("share")).collect()
    share = {r["odd"]: r["share"] for r in got}
    assert share[0] > share[1]


def test_word_tokenizer_equals_the_whole():
    tok = WordTokenizer(vocabulary_path())
    rng = random.Random(2)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x300, 0x330), *range(0x2000, 0x2030), 0x85, 0xA0, 0x3000, 0x1F600, 0x3A3, 0x130]] + ["<|endoftext|>", "'s", "'Ll", " ", "\n", "ß", "a", "b"] * 9
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(tok.encode(text), "<u4").tolist() == tok.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing_round_trip(docs, capacity):
    whole = WordTokenizer(vocabulary_path()).whole
    got = packing.pack_documents(docs, vocabulary_path(), capacity).collect()
    want: Counter = Counter()
    total = 0
    for r in awkward():
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[(r[0], k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) <= 1.1 * total / capacity + 1
    assert packing.pack_documents(docs.limit(0), vocabulary_path(), capacity).count() == 0


def test_packing_plan_is_tight():
    rng = np.random.default_rng(0)
    for n in (1, 10, 3000):
        lengths = np.clip(rng.lognormal(5.5, 1.2, n).astype(int), 1, 4096).tolist()
        plan = packing.packing_plan(dict(Counter(lengths)))
        assert Counter(x for items, k in plan for x in items * k) == Counter(lengths)
        assert all(sum(items) <= 4096 for items, _ in plan)
        assert sum(k for _, k in plan) <= -(-sum(lengths) // 4096) + 2


def test_other_vocabularies_go_through_their_own_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Don't split THIS  like 1234 words\n\né ß 二三"
    assert np.frombuffer(WordTokenizer(path).encode(text), dtype="<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert WordTokenizer(vocabulary_path()).by_word
