"""A light tree of block elements and text runs from raw HTML, and numeric features of its nodes."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# Element names of HTML by how they lay out.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset(
    "script style noscript template svg math iframe object canvas textarea select title audio video".split()
)
NESTING = frozenset("template svg math object canvas audio video".split())
SELF_CLOSED = frozenset(("svg", "math"))
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"),
}
SCOPE = frozenset("ul ol dl table div section article body".split())
# Quoted values may hold ">", but a quote left open ends with the tag. Both ways stop where they have to, without return.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)(?:((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>|([^>]*+)>)")
OPEN_OR_CLOSE = {name: re.compile(rf"<(/?){name}(?=[\s/>])([^>]*+)>", re.IGNORECASE) for name in HIDDEN}
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

TAG_GROUPS = (
    ("p",), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("article",), ("main",), ("section", "details"),
    ("div", "center"), ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tfoot", "tr"),
    ("td", "th", "caption"), ("nav",), ("header",), ("footer",), ("aside", "dialog"),
    ("form", "fieldset", "label", "legend", "button"), ("blockquote", "pre", "figure", "figcaption", "address"),
)
TAG_GROUP = {tag: i for i, tags in enumerate(TAG_GROUPS) for tag in tags}
TOKEN_GROUPS = (
    "article content main post entry story body text page hentry prose",
    "nav navigation menu menubar breadcrumb breadcrumbs topbar navbar toc pagination pager tabs skip",
    "header head masthead top logo branding banner",
    "footer foot bottom copyright legal colophon contentinfo",
    "side sidebar aside rail widget related recommended recommendations more complementary popular trending also",
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp commercial",
    "cookie cookies consent notice alert gdpr popup modal overlay message warning privacy dialog",
    "form search login signup subscribe newsletter register contact input",
    "comment comments reply replies disqus respond discussion reader feedback",
    "share sharing social tags meta byline author date follow",
)
TOKEN_GROUP = {token: i for i, group in enumerate(TOKEN_GROUPS) for token in group.split()}


@dataclass
class Nodes:
    """Nodes of many pages in page order, parents first. A text run is a node without children."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)  # group of the element, -1 for others, -2 for a text run
    tokens: list[int] = field(default_factory=list)  # bits of the attribute token groups
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links
    links: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)  # one after the last descendant

    def add(self, page: int, parent: int, tag: int, tokens: int, text: str = "", linked: int = 0, links: int = 0) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.text.append(text)
        self.linked.append(linked)
        self.links.append(links)
        self.end.append(len(self.page))
        return len(self.page) - 1


def attribute_bits(raw: str, cache: dict[str, int]) -> int:
    if "=" not in raw:
        return 0
    bits = cache.get(raw)
    if bits is None:
        bits = 0
        for value in ATTRIBUTE.findall(raw):
            for part in PART.findall(value):
                group = TOKEN_GROUP.get(part.lower())
                if group is not None:
                    bits |= 1 << group
        if len(cache) < 10_000:
            cache[raw] = bits
    return bits


def _after_hidden(source: str, name: str, at: int, last: int) -> int:
    """Where the hidden element ``name`` ends whose start tag ends at ``at``: at the end of the page if nothing closes it."""
    depth = 1
    for m in OPEN_OR_CLOSE[name].finditer(source, at, last + 1):
        if m[1]:
            depth -= 1
        elif name in NESTING and not (name in SELF_CLOSED and m[2].endswith("/")):
            depth += 1
        if not depth:
            return m.end()
    return len(source)


def tokens(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag, comment and hidden element in order; the rest is text.

    A comment or hidden element has no name; the name of a CDATA section is ``<![CDATA[``, its text the attributes. Left
    open, they reach to the end of the page. Every step goes on where the last one ended, and no tag is looked for
    behind the last ``>``, so the work follows the length of the page.
    """
    last, at = source.rfind(">"), 0
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 2)
            at = end + 3 if end >= 0 else len(source)
            yield start, at, "", False, ""
        elif source.startswith("<![CDATA[", start):
            end = source.find("]]>", start)
            at = end + 3 if end >= 0 else len(source)
            yield start, at, "<![CDATA[", False, source[start + 9 : end if end >= 0 else at]
        elif start > last:
            at = start + 1
        elif source[start + 1] in "!?":
            at = source.find(">", start) + 1
            yield start, at, "", False, ""
        elif m := TAG.match(source, start):
            name, closing, said, at = m[2].lower(), bool(m[1]), m[3] or m[4] or "", m.end()
            if name in HIDDEN and not closing and not (name in SELF_CLOSED and said.endswith("/")):
                at = _after_hidden(source, name, at, last)
                name = ""
            yield start, at, name, closing, said
        else:
            at = start + 1


def parse(source: str | None, page: int, nodes: Nodes, cache: dict[str, int]) -> None:
    """Adds the nodes of a page; a root stands for the page itself.

    Open elements are counted by name, in all and within each scope, so that a tag looks back only for what is there to
    be closed: the work follows the length of the page, however deep it is nested.
    """
    root = nodes.add(page, -1, -1, 0)
    stack: list[tuple[str, int]] = [("", root)]
    opened: Counter[str] = Counter()
    scopes: list[Counter[str]] = [Counter()]
    run: list[str] = []
    linked = links = in_link = 0

    def flush() -> None:
        nonlocal linked, links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                nodes.add(page, stack[-1][1], -2, 0, text, min(linked, len(text)), links)
            run.clear()
        linked = links = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            name, node = stack.pop()
            nodes.end[node] = len(nodes.page)
            if name in SCOPE:
                scopes.pop()
            else:
                scopes[-1][name] -= 1
            opened[name] -= 1

    at, source = 0, source or ""
    for start, end, name, closing, said in tokens(source):
        if start > at:
            piece = source[at:start]
            run.append(piece)
            if in_link:
                linked += len(piece)
        at = end
        if not name:
            continue
        if name == "<![CDATA[":
            run.append(html.escape(said))
            continue
        if name == "a":
            in_link = not closing
            links += not closing
        elif name == "br":
            run.append(" ")
        elif name == "hr":
            flush()
        elif name in BLOCKS:
            flush()
            if closing:
                if opened[name] > 0:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
                    in_link = 0
                continue
            if stack[-1][0] == "p" and name not in ("button", "label"):
                close(len(stack) - 1)
            ends = CLOSES.get(name, ())
            if any(scopes[-1][x] > 0 for x in ends):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in ends))
            if name in ("html", "body") and opened[name] > 0:
                continue
            bits = attribute_bits(said, cache)
            stack.append((name, nodes.add(page, stack[-1][1], TAG_GROUP.get(name, -1), bits)))
            opened[name] += 1
            if name in SCOPE:
                scopes.append(Counter())
            else:
                scopes[-1][name] += 1
    if at < len(source):
        run.append(source[at:])
    flush()
    close(1)
    nodes.end[root] = len(nodes.page)


def _sums(own: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, own.shape[1])), own.cumsum(0)])
    return total[end] - total[np.arange(len(end))]


def features(nodes: Nodes) -> np.ndarray:
    """A row for each node: subtree density, attribute tokens, depth, and what its parent, siblings and ancestors are."""
    n = len(nodes.page)
    parent, end, depth = np.array(nodes.parent), np.array(nodes.end), np.array(nodes.depth)
    tag, bits = np.array(nodes.tag), np.array(nodes.tokens)
    text = nodes.text
    own = np.array(
        [
            (len(t), t.count(" ") + 1 if t else 0, t.count(".") + t.count(",") + t.count("?") + t.count("!"), a, b, bool(t), 1.0)
            for t, a, b in zip(text, nodes.linked, nodes.links, strict=True)
        ],
        dtype=np.float64,
    ).reshape(n, 7)
    total = _sums(own, end)
    chars, word, marks, linked, links, runs, size = total.T
    up = np.where(parent < 0, np.arange(n), parent)
    root = np.flatnonzero(parent < 0)
    of_page = root[np.searchsorted(root, np.arange(n), "right") - 1]

    groups, kinds = len(TAG_GROUPS), len(TOKEN_GROUPS)
    marks_own = (np.where(tag >= 0, 1 << np.maximum(tag, 0), 0) << kinds) | bits
    above = np.zeros(n, np.int64)
    by_depth = np.argsort(depth, kind="stable")
    for here in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[1:]:
        above[here] = above[parent[here]] | marks_own[parent[here]]

    children = np.bincount(up[parent >= 0], minlength=n)
    first = np.flatnonzero(parent >= 0)
    order = first[np.argsort(parent[first], kind="stable")]
    place = np.zeros(n)
    starts = np.r_[True, parent[order][1:] != parent[order][:-1]] if len(order) else np.zeros(0, bool)
    begun = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0)) if len(order) else order
    place[order] = np.arange(len(order)) - begun
    before, after = np.zeros(n), np.zeros(n)
    same = ~starts[1:] if len(order) else starts
    before[order[1:][same]] = chars[order[:-1][same]]
    after[order[:-1][same]] = chars[order[1:][same]]

    ratio = lambda a, b: a / np.maximum(b, 1)
    sibling = children[up]
    columns = [
        tag == -2, np.log1p(chars), np.log1p(word), ratio(marks, word), ratio(linked, chars), np.log1p(links),
        ratio(chars, runs), ratio(size, np.log1p(chars) + 1), ratio(chars, size), depth, sibling, place,
        ratio(place, sibling), ratio(chars, chars[up]), ratio(chars, chars[of_page]), np.log1p(before), np.log1p(after),
        np.log1p(ratio(chars[up], sibling)), ratio(linked[up], chars[up]), children, runs,
        np.array(["©" in t or "(c)" in t for t in text]), ratio(chars, word),
    ]
    for g in range(groups):
        columns += [tag == g, above >> (g + kinds) & 1, tag[up] == g]
    for g in range(kinds):
        columns += [bits >> g & 1, above >> g & 1]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)
