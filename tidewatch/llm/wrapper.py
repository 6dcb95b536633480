"""Main text of web pages by wrapper induction.

The pages of a host share a template. One page of each host is its reference; every page's tree is
aligned with it by simple tree matching. A node whose whole text is the same on nearly all distinct
pages of the host is template, the other text nodes are slots. The content root of a host is the
smallest element of the reference that holds most of its slots. Article and main elements are a hint:
a page that has some is read from all of them, unless the votes find most of its slot text elsewhere.
A page's main text are the blocks under its root or roots, without elements named as menus, adverts,
comments and the like (inside a content root only if template votes or their structure say so too),
and without template blocks. Inside a content root a template block goes only with evidence of its own (a name,
mostly links, a control) or before the first and after the last slot; a heading before a slot stays, as do
headings and sentences that all articles of a host share. A page whose root holds template blocks only keeps them.

Votes are counted inside each task and summed per host and node, so a host with a third of all pages
is spread over all tasks; a wrapper is one page and a list of its nodes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import dom
from tidewatch.llm.tables import Scratch

SAME, LEAST_PAGES = 0.9, 3


def host(url: Column) -> Column:
    """Host of a url, lower-cased; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


class _Trees:
    """Parsed references of the hosts met so far, a bounded number of them."""

    def __init__(self):
        self.by_page: dict[str, dom.Node] = {}

    def get(self, page: str) -> dom.Node:
        tree = self.by_page.get(page)
        if tree is None:
            if len(self.by_page) >= 64:
                self.by_page.clear()
            tree = self.by_page[page] = dom.parse(page)
        return tree


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trees = _Trees()
    for b in batches:
        votes: dict[tuple[str, int], int] = defaultdict(int)
        for h, ref, page in zip(b["host"], b["ref"], b["html"]):
            pairs: list = []
            dom.match(trees.get(ref or ""), dom.parse(page), pairs)
            for x, y in pairs:
                if x.said is not None and x.said == y.said:
                    votes[h, x.index] += 1
        yield pd.DataFrame([(h, i, n) for (h, i), n in votes.items()], columns=["host", "node", "n"])


def _landmarks(root: dom.Node) -> list[dom.Node]:
    """The outermost article elements in page order, else the main elements, that are not themselves boilerplate."""
    for tags in (("article",), ("main",)):
        found, stack = [], [root]
        while stack:
            n = stack.pop()
            if n.tag in tags or (tags == ("main",) and n.named().get("role") == "main"):
                if not n.dropped:
                    found.append(n)
            elif not n.dropped or n.tag == "form":
                stack.extend(reversed(n.kids))
        if found:
            return found
    return []


def _body(root: dom.Node) -> dom.Node:
    return next((n for n in root.walk() if n.tag == "body"), root)


def _size(n: dom.Node, skip) -> int:
    return sum(map(len, dom.blocks(n, skip)))


def _content_root(ref: dom.Node, constant: frozenset[int]) -> dom.Node:
    """The reference's smallest element that holds most of its slots."""
    skip = lambda k: k.index in constant
    at = _body(ref)
    total = _size(at, skip)
    while True:
        inner = [k for k in at.kids if k.tag in dom.BLOCK and not k.dropped and not skip(k) and k.tag not in ("p", "ul", "ol", "table")]
        sizes = [_size(k, skip) for k in inner]
        if not total or max(sizes, default=0) < 0.9 * total:
            return at
        at = inner[sizes.index(max(sizes))]


def _evidence(n: dom.Node) -> bool:
    """Whether a template block is set apart by a name, a control or by being mostly links."""
    inside = list(n.walk())
    links = sum(len(k.text) for a in inside if a.tag == "a" for k in a.walk())
    return n.dropped or any(k.tag in dom.CONTROLS for k in inside) or 2 * links >= sum(len(k.text) for k in inside) > 0


def _going(root: dom.Node, fixed: set[int]) -> set[int]:
    """Python ids of the template blocks under a content root that are no part of the article."""
    gone: set[int] = set()
    said: list[dom.Node | None] = []  # per text in page order its template block, None for a slot
    comments = dom.closing_comments(root)
    stack: list = [(iter(root.parts), None)]
    while stack:
        parts, owner = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
        elif isinstance(part, str):
            if part.strip():
                said.append(owner)
        elif not (part.boilerplate or id(part) in comments):
            if id(part) in fixed:
                if _evidence(part):
                    gone.add(id(part))
                    continue
                owner = part
            stack.append((iter(part.parts), owner))
    slots = [i for i, n in enumerate(said) if n is None]
    for i, n in enumerate(said):
        heads = n is not None and n.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and said[i + 1:i + 2] == [None]
        if n is not None and not heads and not (slots and slots[0] < i < slots[-1]):
            gone.add(id(n))
    return gone


def page_text(page: str | None, ref: dom.Node | None, constant: frozenset[int]) -> str:
    tree = dom.parse(page)
    pairs: list = []
    if ref is not None:
        dom.match(ref, tree, pairs)
    fixed = {id(y) for x, y in pairs if x.index in constant and y.tag in dom.BLOCK and x.said == y.said}
    skip = lambda n: id(n) in fixed
    body, roots = _body(tree), _landmarks(tree)
    if roots and fixed and 2 * sum(_size(n, skip) for n in roots) < _size(body, skip):
        roots = []  # the votes find the slots elsewhere
    if not roots and ref is not None:
        goal = _content_root(ref, constant)
        roots = [y for x, y in pairs if x is goal]
    roots = roots or [body]
    inside = roots != [body]  # under the body menus and the like go by their names alone
    if inside and fixed:
        gone = set().union(*(_going(n, fixed) for n in roots))
        skip = lambda n: id(n) in gone
    read = lambda skip: "\n".join(line for n in roots for line in dom.blocks(n, skip, inside))
    return read(skip) or (read(lambda n: False) if inside else "")


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trees = _Trees()
    for b in batches:
        out = []
        for page, ref, constant in zip(b["html"], b["ref"], b["constant"]):
            fixed = frozenset() if constant is None else frozenset(int(i) for i in constant)
            out.append(page_text(page, trees.get(ref) if ref else None, fixed))
        yield b[["page_id", "url"]].assign(text=out, n_chars=[len(t) for t in out])


def wrappers(pages: DataFrame, same: float = SAME, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, ref, constant): a host's reference page and the numbers of its template nodes, from (host, html).

    Equal pages of a host vote once. A host with fewer than ``least_pages`` distinct pages has no
    template nodes.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "wrapper")
    distinct = pages.where("html like '%<%'").withColumn("h", F.xxhash64("html"))
    refs = scratch.write(distinct.groupBy("host").agg(F.min_by("html", "h").alias("ref"), F.count_distinct("h").alias("pages"))).df
    one = distinct.groupBy("host", "h").agg(F.any_value("html").alias("html"))  # equal pages: any row of them is the page
    votes = one.select("host", "html").join(refs.where(F.col("pages") >= least_pages), "host") \
        .mapInPandas(_votes, "host string, node int, n long")
    fixed = votes.groupBy("host", "node").agg(F.sum("n").alias("n")).join(refs.select("host", "pages"), "host") \
        .where(F.col("n") >= F.lit(same) * F.col("pages")).groupBy("host").agg(F.collect_list("node").alias("constant"))
    return refs.select("host", "ref").join(scratch.write(fixed).df, "host", "left")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 same: float = SAME, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per row of ``pages``.

    Null and empty pages have an empty text; pages whose url is null or has no host are one host.
    Elements nested deeper than 150 levels become siblings; nothing is cut. Rows that repeat a page
    each get its text; only the three named columns are read; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html"), host(F.col(url_col)).alias("host"))
    by_host = scratch.write(wrappers(src, same, least_pages)).df
    out = src.join(by_host, "host", "left").select("page_id", "url", "html", "ref", "constant").mapInPandas(
        _texts, "page_id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
