"""Main text of web pages by wrappers that are induced from the pages of a host.

A host's wrapper is the tree of one of its pages. Every other page of the host is aligned with it by simple tree
matching: nodes with the same label match, children in order, so that as many nodes as possible match. A wrapper node
that has the same text on nearly all pages is template where a page has that text; nodes whose text varies are slots, and slots outside menus,
adverts and other parts that their element names give away are content. Runs of like siblings, such as the paragraphs
of an article, are one slot, so that a match costs no more for a long page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import slices, written

#: Element names and words of HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = re.compile(r"<(script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
APART = set("head nav footer aside form button select menu dialog object canvas".split())
APART_OUTSIDE = {"header"}
APART_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login masthead menu modal nav navbar"
    " navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup"
    " skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
APART_WORDS_OUTSIDE = {"header"}
ROOTS = {"html", "body", "article", "main"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>|</([a-zA-Z][\w:-]*)[^>]*>|<([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Share of the text that could be content from which part of a name does not make an element boilerplate.
MOST = 2 / 3
#: Elements nested deeper than this hang on their ancestor at this depth.
DEEPEST = 150
#: A wrapper node is template if its text is the same on this share of the pages, of at least so many.
CONSTANT, PAGES = 0.8, 5


@dataclass
class Node:
    tag: str
    names: frozenset = frozenset()
    tokens: frozenset = frozenset()  # whole class names, ids and roles; ``names`` has their parts
    children: list = field(default_factory=list)
    text: str = ""  # of a leaf: its blocks of text
    apart: bool = False
    id: int = -1
    size: int = 0  # characters of text in it

    @property
    def label(self) -> tuple:
        return self.tag, self.names


def parse(page: str) -> Node:
    """The tree of a page: elements that contain blocks, and leaves with the text of each block."""
    root = Node("html")
    stack, words = [root], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            stack[-1].children.append(Node("#text", text=text))

    def close(tags: set, until: set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    for end, start, attributes, text in TOKEN.findall(RAW.sub(" ", page)):
        if text:
            words.append(text)
            continue
        tag = (start or end).lower()
        if not tag:
            continue
        if tag in INLINE:
            continue
        if tag in VOID:
            words.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in ("td", "th"):  # the cells of a row are one block
            words.append(" ")
            continue
        if end:
            close({tag}, {"article", "main"} - {tag} if tag not in ROOTS else set())
            continue
        if tag in ("html",):
            continue
        if tag in CLOSES_P:
            close({"p"}, {"article", "main", "div", "li"})
        if tag in SIBLINGS:
            close(SIBLINGS[tag], {"ul", "ol", "dl", "table"})
        flush()
        found = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower()
        node = Node(tag, frozenset(w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=\d)", found) if w and not w.isdigit()), frozenset(found.split()))
        stack[-1].children.append(node)
        if len(stack) < DEEPEST:
            stack.append(node)
    flush()
    _measure(root)
    _settle(root, False, MOST * (root.size - _surely_apart(root)))
    _number(root)
    return root


def _measure(node: Node) -> int:
    node.size = len(node.text) + sum(map(_measure, node.children))
    return node.size


def _surely_apart(node: Node) -> int:
    """Characters in parts whose element or whole name says that they are no content."""
    if node.tag not in ROOTS and (node.tag in APART - {"form"} or node.tokens & APART_WORDS):
        return node.size
    return sum(map(_surely_apart, node.children))


def _settle(node: Node, inside: bool, most: float) -> None:
    """Mark parts that are no content by their names, and make one leaf of each run of like blocks of text.

    A whole name tells, such as ``sidebar``. Part of a name, as in ``no-sidebar``, or a form does not where the element
    holds over ``most`` characters, nearly all of what could be content.
    """
    inside = inside or node.tag in ("article", "main")
    if node.tag not in ROOTS:
        hinted = node.tag == "form" or bool(node.names & APART_WORDS) or (not inside and bool(node.names & APART_WORDS_OUTSIDE))
        sure = node.tag in APART - {"form"} or bool(node.tokens & APART_WORDS) or (not inside and (node.tag in APART_OUTSIDE or bool(node.tokens & APART_WORDS_OUTSIDE)))
        node.apart = sure or (hinted and node.size <= most)
    out: list[Node] = []
    for child in node.children:
        if child.tag != "#text":
            _settle(child, inside, most)
            if not child.children and not child.text:
                continue
            if all(c.tag == "#text" for c in child.children) and child.tag not in ROOTS:
                child.text, child.children = "\n".join(c.text for c in child.children), []
        last = out[-1] if out else None
        if last and not child.children and not last.children and last.label == child.label:
            last.text += "\n" + child.text
        else:
            out.append(child)
    node.children = out


def _number(root: Node) -> None:
    stack, n = [root], 0
    while stack:
        node = stack.pop()
        node.id, n = n, n + 1
        stack.extend(reversed(node.children))


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of matched nodes of a largest simple tree matching of two trees with the same root label."""
    known: dict[tuple[int, int], tuple[int, list]] = {}

    def match(x: Node, y: Node) -> int:
        if (x.id, y.id) in known:
            return known[x.id, y.id][0]
        m, n = len(x.children), len(y.children)
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            row, above = best[i + 1], best[i]
            for j in range(n):
                top = max(above[j + 1], row[j])
                if x.children[i].label == y.children[j].label:
                    top = max(top, above[j] + match(x.children[i], y.children[j]))
                row[j + 1] = top
        pairs, i, j = [], m, n
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x.children[i], y.children[j]))
        known[x.id, y.id] = (best[m][n] + 1, pairs)
        return best[m][n] + 1

    match(a, b)
    out, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        out.append((x, y))
        stack.extend(known[x.id, y.id][1])
    return out


@lru_cache(maxsize=64)
def _wrapper(page: str) -> Node:
    return parse(page)


def content(page: str, wrapper: str, template: set[int]) -> str:
    """The blocks of a page that are content, joined by an empty line."""
    root = parse(page)
    constant = {x.id for x, y in align(root, _wrapper(wrapper)) if y.id in template and x.text == y.text} if template else set()

    def blocks(skip: set[int]) -> tuple[list[str], list[str]]:
        """Blocks in the articles of the page, and in the whole page."""
        inside: list[str] = []
        all_: list[str] = []
        stack = [(root, False)]
        while stack:
            node, within = stack.pop()
            if node.apart or node.id in skip:
                continue
            within = within or node.tag in ("article", "main")
            if node.text:
                lines = node.text.split("\n")
                all_ += lines
                inside += lines if within else []
            stack.extend((c, within) for c in reversed(node.children))
        return inside, all_

    inside, all_ = blocks(constant)
    if not all_ and constant:  # a host of equal pages has no slots
        inside, all_ = blocks(set())
    return "\n\n".join(inside or all_)


def _host(url) -> F.col:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1), F.lit(""))


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and wrapper node: pages that match it, and those with its text."""
    for batch in batches:
        matched: Counter = Counter()
        equal: Counter = Counter()
        for part in slices(batch, "html"):
            for host, page, wrapper in zip(*(part.column(n).to_pylist() for n in ("host", "html", "wrapper"))):
                for x, y in align(parse(page or ""), _wrapper(wrapper or "")):
                    if y.text:
                        matched[host, y.id] += 1
                        equal[host, y.id] += x.text == y.text
        rows = [(h, i, n, equal[h, i]) for (h, i), n in matched.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("host", "node", "pages", "equal"), r)) for r in rows], pa.schema([("host", pa.string()), ("node", pa.int32()), ("pages", pa.int64()), ("equal", pa.int64())]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            rows = zip(*(part.column(n).to_pylist() for n in ("html", "wrapper", "template")))
            texts = [content(page or "", wrapper or "", set(nodes or ())) for page, wrapper, nodes in rows]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def main_text(pages: DataFrame, page: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per page: ``row`` (all its columns) and ``text``, its main text ('' if it has none).

    A null page is empty; pages without a readable url are one host. A host's wrapper is its page with the least key,
    of equal keys the least text; a host with fewer than ``PAGES`` others has no template. Repeated rows have equal
    results; an empty table gives an empty result.
    """
    rows = pages.select(F.struct("*").alias("row"), F.coalesce(F.col(page), F.lit("")).alias("html"), _host(F.col(url)).alias("host"), F.col(key).alias("id"))
    first = rows.groupBy("host").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", F.xxhash64("html").alias("body"))).alias("first"))
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", F.xxhash64("html").alias("body"))
    wrappers = rows.withColumn("own", own).join(first, "host").filter("own = first").groupBy("host").agg(F.min("html").alias("wrapper"), F.first("first").alias("first"))
    wrappers = written(wrappers, "wrappers")
    others = rows.withColumn("own", own).join(wrappers, "host").filter("own <> first").select("host", "html", "wrapper")
    seen = others.mapInArrow(_evidence, "host string, node int, pages long, equal long").groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("equal").alias("equal"))
    template = seen.filter((F.col("pages") >= PAGES) & (F.col("equal") >= F.col("pages") * CONSTANT)).groupBy("host").agg(F.collect_list("node").alias("template"))
    known = written(wrappers.join(template, "host", "left").select("host", "wrapper", "template"), "templates")
    whole = rows.join(known, "host").select("row", "html", "wrapper", "template")
    return whole.mapInArrow(_extract, f"row {whole.schema['row'].dataType.simpleString()}, text string")
