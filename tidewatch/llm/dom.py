"""A small page tree: tolerant parsing, simple tree matching, text blocks. Used inside tasks, one page at a time."""

from __future__ import annotations

import html as _html
import math
import re

import numpy as np

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
                  "search section summary table tbody td tfoot th thead tr ul".split())
#: An open element that a start tag closes: tag -> (closed tags, tags that stop the search).
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tr", "thead", "tbody"), ("table",)), "tfoot": (("tr", "tbody", "thead"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
#: Elements that never hold the text of an article.
DROP_TAGS = frozenset("nav footer aside form script style noscript template iframe svg button select textarea input "
                      "dialog menu head title object canvas audio video math".split())
#: Whole tokens of class, id and role that name menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login popup modal "
    "overlay paywall sidebar sidebars side rail menu menus nav navs navbar navigation breadcrumb breadcrumbs pagination pager "
    "toolbar header masthead footer foot bottombar topbar comment comments commentlist reply replies respond disqus discussion "
    "reactions social share sharing related recommended widget widgets form search contentinfo complementary skip toc".split())
ARTICLE_WORDS = frozenset("comment comments reply ad advert promo related teaser".split())
#: Elements whose id is made from a heading.
SLUGGED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
CONTROLS = frozenset("form input textarea select button iframe".split())
#: Names of reader comments, which close an article without a structure of their own.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
MAX_DEPTH = 150

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
#: What can still be markup when no '>' follows.
_LAST = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?].*", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "parts", "index", "text", "said", "whole", "full", "_drop")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs = tag, attrs
        self.kids: list[Node] = []
        self.parts: list = []  # texts and kids in page order
        self.index = 0
        self.text = ""  # own text, white space collapsed
        self.said: int | None = None  # hash of the subtree's tags and texts, None without text
        self.whole = 0  # hash of the subtree with its attributes
        self.full = 0  # the subtree's weight against its equal
        self._drop: bool | None = None

    def add(self, kid: "Node") -> None:
        self.kids.append(kid)
        self.parts.append(kid)

    def named(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(self.attrs)} if self.attrs else {}

    @property
    def by_tag(self) -> bool:
        """Whether the tag alone names something that is not the article."""
        return self.tag in DROP_TAGS or self.tag == "header" and not any(n.tag in ("h1", "h2") for n in self.walk())

    def names(self) -> list[str]:
        """Tokens of class and role and the id, each whole, lower-cased, without - and _. Ids of headings and sections are slugs, not names."""
        if not self.attrs or self.tag in ("html", "body", "main"):
            return []
        named = self.named()
        said = named.get("class", "").split() + named.get("role", "").split()
        if self.tag not in SLUGGED:
            said.append(named.get("id", "").strip())
        return [w.replace("-", "").replace("_", "").lower() for w in said]

    @property
    def dropped(self) -> bool:
        """Whether tag, class, id or role names something that is not the article."""
        if self._drop is None:
            words = ARTICLE_WORDS if self.tag == "article" else DROP_WORDS
            self._drop = self.by_tag or any(w in words for w in self.names())
        return self._drop

    @property
    def boilerplate(self) -> bool:
        """Whether it is not the article by its tag, or by its name and its structure: mostly links, or with controls to fill in."""
        if not self.dropped:
            return False
        if self.by_tag:
            return True
        inside = list(self.walk())
        if any(n.tag in CONTROLS for n in inside):
            return True
        links = sum(len(k.text) for n in inside if n.tag == "a" for k in n.walk())
        return 2 * links >= sum(len(n.text) for n in inside)

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))

    def own(self) -> str:
        """Texts directly inside this element."""
        return "\n".join(p for p in self.parts if isinstance(p, str))


def parse(page: str | None) -> Node:
    """The page's tree under a root element. Never fails: unknown and broken markup is text or ignored."""
    page = page or ""
    root = Node("#root", "")
    open_: list[Node] = [root]
    at, end = 0, len(page)
    last = page.rfind(">")  # without one a tag cannot end: no search for it
    while at < end:
        m = _TAG.search(page, at) if at <= last else _LAST.search(page, at)
        if m is None:
            open_[-1].parts.append(page[at:])
            break
        if m.start() > at:
            open_[-1].parts.append(page[at:m.start()])
        at = m.end()
        tag = m.re is _TAG and (m[2] or m[5])
        if not tag:
            if m[0].startswith("<![CDATA["):
                open_[-1].parts.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
                if open_[i].tag in ("td", "th", "table", "article", "body") and tag not in ("table", "tr", "article", "body", "html", "main", "div", "section"):
                    break
            continue
        if tag in BLOCK:
            closed, stop = CLOSES.get(tag, ((), ()))
            for i in range(len(open_) - 1, 0, -1):
                t = open_[i].tag
                if t == "p" or t in closed:
                    del open_[i:]
                    if t == "p" and closed:
                        continue
                    break
                if t in stop or (t in BLOCK and not closed) or t in ("button", "table", "template"):
                    break
        attrs = m[3] or m[6] or ""
        node = Node(tag, attrs)
        open_[-1].add(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at) if at <= last else None
            node.parts.append(page[at:close.start() if close else end])
            at = close.end() if close else end
            continue
        if len(open_) < MAX_DEPTH and not attrs.rstrip().endswith("/") or tag in BLOCK and len(open_) < MAX_DEPTH:
            open_.append(node)
    nodes = list(root.walk())
    for i, n in enumerate(nodes):
        n.index = i
    for n in reversed(nodes):
        n.text = " ".join(n.own().split())
        n.whole = hash((n.tag, n.attrs, n.text, *[k.whole for k in n.kids]))
        n.full = 3 + 4 * (n.text != "") + sum(k.full for k in n.kids)
        if n.text or any(k.said is not None for k in n.kids):
            n.said = hash((n.tag, n.text, *[k.said for k in n.kids]))
    return root


def closing_comments(root: Node) -> set[int]:
    """Python ids of the elements named as reader comments after which no other text follows under ``root``."""
    found: set[int] = set()
    at = root
    while True:
        last = None
        for part in reversed(at.parts):
            if isinstance(part, str):
                if part.strip():
                    return found
            elif part.boilerplate or part.said is None:
                continue
            elif any(w in COMMENT_WORDS for w in part.names()):
                found.add(id(part))
            else:
                last = part
                break
        if last is None:
            return found
        at = last


def blocks(node: Node, skip=lambda n: False, inside: bool = False) -> list[str]:
    """Texts of the blocks under ``node`` in page order: references decoded, white space collapsed, no empty ones.

    Elements that a name sets apart are left out; ``inside`` an article their structure has to say so too.
    """
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join(_html.unescape("".join(run)).split())
            run.clear()
            if text:
                out.append(text)

    comments = closing_comments(node) if inside else set()
    stack: list = [iter(node.parts)]
    ends: list[bool] = [True]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            if ends.pop():
                flush()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append(" ")
        elif not ((part.boilerplate or id(part) in comments if inside else part.dropped) or skip(part)):
            block = part.tag in BLOCK
            if block:
                flush()
            stack.append(iter(part.parts))
            ends.append(block)
        elif part.tag in BLOCK:
            flush()
    return out


#: Scores of node pairs remembered during one match; beyond it they are worked out again, with the same result.
MEMO = 400_000


def _ends(ka: list[Node], kb: list[Node]) -> tuple[int, int]:
    """Lengths of the equal head and tail of two child lists. A subtree weighs most against its equal, so these pairs are optimal."""
    least = min(len(ka), len(kb))
    lead = tail = 0
    while lead < least and ka[lead].whole == kb[lead].whole:
        lead += 1
    while tail < least - lead and ka[-1 - tail].whole == kb[-1 - tail].whole:
        tail += 1
    return lead, tail


#: Lists with more pairs than this are aligned row by row with numpy; the weights are the same.
PAIRS = 600


class _Pairs:
    """The rows of the alignment of two child lists: best weight of the children so far and the first j of ``kb``."""

    def __init__(self, ka: list[Node], kb: list[Node], memo: dict):
        self.kb, self.memo = kb, memo
        self.long = len(ka) * len(kb) > PAIRS
        self.first = np.zeros(len(kb) + 1, np.int64) if self.long else [0] * (len(kb) + 1)
        if self.long:
            self.columns = [np.array([f(y) for y in kb], np.int64) for f in (
                lambda y: hash(y.tag), lambda y: hash(y.attrs), lambda y: hash(y.text), lambda y: y.whole, lambda y: y.full, lambda y: bool(y.kids))]
            if any(x.kids for x in ka) and any(y.kids for y in kb):
                self._kinds(ka, kb)

    def _kinds(self, ka: list[Node], kb: list[Node]) -> None:
        """Numbers the subtrees by all that their weight against the other list's depends on: a text that only one
        list has is like any other such text."""
        both = {n.text for x in ka for n in x.walk()} & {n.text for y in kb for n in y.walk()}
        numbers: dict = {}
        self.kind: dict[int, int] = {}
        for x in (*ka, *kb):
            for n in reversed(list(x.walk())):
                key = n.tag, n.attrs, n.text if n.text in both else n.text != "", *[self.kind[id(k)] for k in n.kids]
                self.kind[id(n)] = numbers.setdefault(key, len(numbers))
        self.kind_b = np.array([self.kind[id(y)] for y in kb])
        self.known: dict[tuple[int, int], int] = {}

    def row(self, x: Node, above):
        if not self.long:
            return self._short_row(x, above)
        tag, attrs, text, whole, full, kids = self.columns
        before, up = above[:-1], above[1:]
        equal = whole == x.whole
        weight = 2 + (attrs == hash(x.attrs))
        if x.text:
            weight += 4 * (text == hash(x.text))
        weight = np.where(equal, full, weight)
        same = tag == hash(x.tag)
        sure = same & (equal | (kids == 0)) if x.kids else same
        with_x = np.where(sure, before + weight, 0)
        best = np.maximum.accumulate(np.maximum(up, with_x))
        if x.kids:  # pairs with children on both sides, unless the heaviest possible weight changes nothing
            js = np.flatnonzero(same & ~sure & (before + np.minimum(full, x.full) > best))
            if len(js):
                kinds, first, of = np.unique(self.kind_b[js], return_index=True, return_inverse=True)
                with_x[js] = before[js] + np.array([self._known(x, self.kb[js[f]], int(k)) for k, f in zip(kinds, first)], np.int64)[of]
                best = np.maximum.accumulate(np.maximum(up, with_x))
        return np.concatenate(([0], best))

    def _known(self, x: Node, y: Node, kind: int) -> int:
        key = self.kind[id(x)], kind
        if key not in self.known:
            self.known[key] = _score(x, y, self.memo)
        return self.known[key]

    def _short_row(self, x: Node, above: list[int]) -> list[int]:
        row, best, tag, full = [0], 0, x.tag, x.full
        for j, y in enumerate(self.kb):
            up = above[j + 1]
            if up > best:
                best = up
            if y.tag == tag and above[j] + min(full, y.full) > best:
                best = max(best, above[j] + _score(x, y, self.memo))
            row.append(best)
        return row


def _score(a: Node, b: Node, memo: dict) -> int:
    """Weight of the best match of two subtrees of equal tag: 2 a pair, 1 more for equal attributes, 4 for an equal text."""
    if a.whole == b.whole:
        return a.full
    own = 2 + (a.attrs == b.attrs) + 4 * (a.text == b.text != "")
    if not a.kids or not b.kids:
        return own
    key = a.index, b.index
    known = memo.get(key)
    if known is None:
        lead, tail = _ends(a.kids, b.kids)
        ka, kb = a.kids[lead:len(a.kids) - tail], b.kids[lead:len(b.kids) - tail]
        known = own + sum(n.full for n in a.kids[:lead]) + sum(n.full for n in a.kids[len(a.kids) - tail:])
        if ka and kb:
            table = _Pairs(ka, kb, memo)
            row = table.first
            for x in ka:
                row = table.row(x, row)
            known += int(row[-1])
        if len(memo) < MEMO:
            memo[key] = known
    return known


def _aligned(ka: list[Node], kb: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """The pairs of the heaviest order-keeping alignment of two child lists.

    Every k-th row is kept and the rows between are worked out again on the way back, so a list of n
    children takes the square root of n rows of memory, whatever its length.
    """
    lead, tail = _ends(ka, kb)
    out = [*zip(ka[:lead], kb[:lead]), *zip(ka[len(ka) - tail:], kb[len(kb) - tail:])]
    ka, kb = ka[lead:len(ka) - tail], kb[lead:len(kb) - tail]
    if not ka or not kb:
        return out
    step = max(16, math.isqrt(len(ka)))
    table = _Pairs(ka, kb, memo)
    kept, row = [], table.first
    for i, x in enumerate(ka):
        if i % step == 0:
            kept.append(row)
        row = table.row(x, row)
    j = len(kb)
    for block in range(len(kept) - 1, -1, -1):
        at = block * step
        rows = [kept[block]]
        for x in ka[at:at + step]:
            rows.append(table.row(x, rows[-1]))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((ka[at + i], kb[j]))
    return out


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]]) -> int:
    """Simple tree matching: size of the heaviest order-keeping top-down match; its node pairs go to ``pairs``.

    All child lists are aligned by weight, those of equal tags too, whatever their length.
    """
    if a.tag != b.tag:
        return 0
    memo: dict = {}
    before, stack = len(pairs), [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        if x.whole == y.whole:
            stack.extend(zip(x.kids, y.kids))
        elif x.kids and y.kids:
            stack.extend(_aligned(x.kids, y.kids, memo))
    return len(pairs) - before
