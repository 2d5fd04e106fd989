"""Operator 2: main text of HTML pages by site style trees.

Pages of one host are merged into a style tree whose nodes are element paths.
A node's presentation importance is the entropy of its children's tag
sequences over the host's pages, its content importance the entropy of its texts;
a branch that looks and reads the same on page after page has little of either and is
removed from each page. What a page says about itself comes first: semantic
elements, roles and class names for menus, headers, footers, adverts, forms and the like
are dropped, and an ``article`` or ``main`` is kept whatever its host repeats. What holds an article is
no menu and no form, whatever its name.

The tree is never built in one place: each page emits a few hashes per branch, which are
counted by (host, path) with map-side combining, so a host with a third of all
pages is spread over all tasks. Only the low branches of each host return to its pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.store import materialize

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^"'>]|"[^"]*"|'[^']*')*)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, and no part of a page's text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first closes an open element of the second.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
DROPPED = frozenset("nav footer aside form script style template noscript iframe svg math button select textarea input object canvas audio video dialog head title menu fieldset search datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status log".split())
#: Words of a class or id that mark what does not belong to the main text.
MARKS = frozenset(
    "nav navbar navigation menu sidebar side aside footer masthead topbar ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies disqus discussion respond related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar widget copyright skip".split()
)
#: Words that may stand beside a mark in one name; with any other word a name marks nothing ("has-sidebar", "share-price").
BESIDE = frozenset("site page global main wrapper wrap container box block area section list left right top bottom inner outer post posts links icons bar form unit slot".split())
CONTAINERS = frozenset("div section ul ol dl table header figure center blockquote hgroup details".split())
MAIN_ROLES = frozenset(("main", "article"))


def marked(name: str) -> bool:
    """Whether a class or id consists of marks, and of words that may stand beside them."""
    parts = [w for w in re.split(r"[_-]+", name) if w]
    return any(w in MARKS for w in parts) and all(w in MARKS or w in BESIDE for w in parts)


class Node:
    __slots__ = ("tag", "words", "kids", "path", "role", "hidden")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.kids, self.words, self.role, self.hidden = tag, [], (), "", False
        label = tag
        if attrs.strip():
            found = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTR.findall(attrs)}
            self.role = found.get("role", "").lower()
            self.words = tuple(f"{found.get('class', '')} {found.get('id', '')}".lower().split())
            self.hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs)) or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            label = ".".join((tag, *sorted(found.get("class", "").lower().split())))
        self.path = f"{up.path}/{label}" if up else label

    def main(self) -> bool:
        return self.tag in ("article", "main") or self.role in MAIN_ROLES

    def dropped(self, in_main: bool) -> bool:
        if self.tag in DROPPED or self.hidden or self.role in ROLES:
            return True
        if self.tag == "header" and not in_main:
            return True
        if self.tag in ("html", "body") or self.main():
            return False
        return any(marked(w) for w in self.words) or (not in_main and "header" in self.words)


def parse(html: str) -> Node:
    """A tree of nodes and strings, as lenient as a browser in the common cases."""
    root = Node("#root", "", None)
    stack, at, n = [root], 0, len(html)

    def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    while at < n:
        m = TAG.search(html, at)
        if not m:
            stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            inline = name not in BLOCK
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if inline and stack[k].tag in BLOCK:
                    break
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in BLOCK:
            close(("p",), ("td", "th", "button", "object", "table"))
        if name in IMPLIED:
            for _ in range(3):
                close(IMPLIED[name], _SCOPE[name])
        node = Node(name, attrs, stack[-1])
        stack[-1].kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
        elif name not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(node)
    return root


def blocks(node: Node, low: frozenset[int], in_main: bool = False, menus: bool = False) -> list[str]:
    """Texts of the blocks below ``node`` in page order, without dropped elements, low branches and, if asked, menus."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    # an explicit stack, as markup may be nested arbitrarily deep
    todo: list[tuple] = [(node, in_main, False)]
    while todo:
        item, inside, over = todo.pop()
        if isinstance(item, str):
            held.append(item)
            continue
        block = item.tag in BLOCK
        if over:
            flush()
            continue
        if item is not node:
            if item.dropped(inside) and not (item.tag == "form" and wraps_page(item)):
                if block:
                    flush()
                continue
            if low and item.tag in CONTAINERS and hash_of(item.path) in low and not holds_main(item) and branch_of(item) in low:
                flush()
                continue
            if menus and item.tag in CONTAINERS and menu(item):
                flush()
                continue
        if item.tag in ("br", "hr"):
            held.append(" ")
        if block:
            flush()
            todo.append((item, inside, True))
        inside = inside or item.main()
        todo.extend((kid, inside, False) for kid in reversed(item.kids))
    flush()
    return out


def walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(k for k in reversed(node.kids) if not isinstance(k, str))


def holds_main(node: Node) -> bool:
    return any(n.main() for n in walk(node))


def wraps_page(node: Node) -> bool:
    """Whether a form is wrapped around a page: it holds an article, a main, or a first-level heading."""
    return any(n.main() or n.tag == "h1" for n in walk(node))


def mains(root: Node) -> list[Node]:
    """The outermost articles and mains that are not in a dropped element; a main that holds articles gives way to them.

    If all are in dropped elements, those in none but elements that are dropped for their names, or forms, count.
    """
    for lenient in (False, True):
        found: list[Node] = []
        todo = [root]
        while todo:
            node = todo.pop()
            if node is not root and node.dropped(False) and not (node.tag == "form" and wraps_page(node)):
                if not lenient or node.tag in DROPPED or node.tag == "header" or node.hidden:
                    continue
            if node.main():
                inner = [n for n in walk(node) if n is not node and n.tag == "article"]
                if node.tag == "article" or not inner:
                    found.append(node)
                    continue
            todo.extend(k for k in reversed(node.kids) if not isinstance(k, str))
        if found:
            return found
    return []


def menu(node: Node) -> bool:
    """Whether a branch is mostly links, three or more: such is a menu even on a host without other pages to compare."""
    texts, links, n = 0, 0, 0
    todo: list[tuple] = [(node, False)]
    while todo:
        item, linked = todo.pop()
        if isinstance(item, str):
            size = len("".join(item.split()))
            texts, links = texts + size, links + size * linked
        elif item.tag not in RAW:
            n += item.tag == "a"
            todo.extend((k, linked or item.tag == "a") for k in item.kids)
    return n >= 3 and links > 0.8 * texts


def hash_of(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "replace"), 0) - (1 << 63)


def branch_of(node: Node, content: int | None = None) -> int:
    """A branch by its path and text."""
    return hash_of(f"{node.path}\n{hash_of(chr(10).join(blocks(node, frozenset()))) if content is None else content}")


def extract(html: str | None, low: frozenset[int] = frozenset()) -> str:
    """The page's main text; empty if it has none.

    Without an article or main, branches of links go, too. A page of which nothing but low
    branches is left has no text of its own and keeps them.
    """
    root = parse(html or "")
    starts = mains(root)

    def text(low: frozenset[int]) -> str:
        if starts:
            return "\n".join(b for s in starts for b in blocks(s, low, True))
        return "\n".join(blocks(root, low, menus=True) or blocks(root, low))

    return (text(low) if low else "") or text(frozenset())


def branch_rows(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, nth, style, content, branch`` of each page's removable branches: hashes of path, child tags, text, and path with text.

    nth counts a page's branches with one path, each of which has a place of its own in the tree.
    """

    def branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen: Counter = Counter()
                for node in walk(parse(html.as_py() or "")):
                    if node.tag in CONTAINERS and not node.dropped(False) and not holds_main(node):
                        path, content = hash_of(node.path), hash_of("\n".join(blocks(node, frozenset())))
                        style = hash_of(" ".join(k.tag for k in node.kids if not isinstance(k, str)))
                        rows.append((host, path, seen[path], style, content, branch_of(node, content)))
                        seen[path] += 1
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["host", "path", "nth", "style", "content", "branch"])

    return pages.select(host_of(url_col), F.col(html_col).alias("html")).mapInArrow(branches, "host string, path long, nth long, style long, content long, branch long")


def host_of(url_col: str):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("")).alias("host")


def low_branches(rows: DataFrame, least_pages: int = 2, threshold: float = 0.3, gamma: float = 0.9) -> DataFrame:
    """``host, low``: hashes of the paths that have a place whose importance is below ``threshold``, and of the branches that repeat there.

    Importance is (1 - gamma) times the entropy of the styles plus gamma times that of
    the contents, each to the base of the number of pages, so that it lies in 0 to 1.
    """
    place = ["host", "path", "nth"]
    counted = rows.groupBy(*place, "style", "content", "branch").agg(F.count("*").alias("n"))

    def entropy(key: str) -> DataFrame:
        n = counted.groupBy(*place, key).agg(F.sum("n").alias("n"))
        return n.groupBy(*place).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("s")).select(*place, "m", ((F.ln("m") - F.col("s") / F.col("m")) / F.ln(F.greatest("m", F.lit(2)))).alias(key))

    both = entropy("style").join(entropy("content").drop("m"), place)
    low = both.filter((F.col("m") >= least_pages) & ((1 - gamma) * F.col("style") + gamma * F.col("content") < threshold)).select(*place)
    repeated = counted.groupBy(*place, "branch").agg(F.sum("n").alias("n")).filter("n > 1").join(low, place)
    return repeated.select("host", F.explode(F.array("path", "branch")).alias("hash")).groupBy("host").agg(F.sort_array(F.collect_set("hash")).alias("low"))  # of one host's templates


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **importance) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Null html counts as empty and has empty text; pages without a host share one
    tree. Repeated rows are pages of their own. Other columns are ignored.
    """
    low = materialize(low_branches(branch_rows(pages, url_col, html_col), **importance), "html-low")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(url_col), F.col(html_col).alias("html"))
    rows = rows.join(low, "host", "left").select("page_id", "url", "html", "low")  # broadcast by Spark while the table's size allows
    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(h.as_py(), frozenset(v or ())) for h, v in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema.names)

    return rows.mapInArrow(texts, schema)
