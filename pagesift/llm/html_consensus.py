"""Main text of web pages by the consensus of their host.

    1. Every page's containers (elements such as article, main, section, div, td, body) get a
       score from the text of their blocks, most of it from blocks directly inside, less their
       link text. A container is named by its generalised path: the tags from the body down, each
       with its class names, digits replaced and numbers of siblings left out.
    2. The score finds where most of the text is; a title, a lead or other parts may lie outside.
       So each path climbs to enclosing paths: to the nearest article or main, or to a container
       below the body with a heading (h1, h2) directly inside, if that holds any more text that is
       not linked, and to any container that holds at least ``CLIMB`` more of it (``CLIMB_OUT`` beyond
       an article or main), most of what it adds being not linked.
    3. In Spark, every page votes for what its best paths climb to; votes are added up by host.
    4. Pages are read again and the elements on the host's winning path are taken, or those of the
       article, main or headed container around them that has more on this page; a page that has
       no such element, or none with text, uses its own best container and what that climbs to.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are told by tag, role and class names and give no text. Inside an article or main a class name tells
so only as a whole ("share", not "share-prices"); an element with such a word as a part of its name goes
there if at least half of its text is linked, and stays otherwise.

Votes of a host are grouped sums, combined before the shuffle, so a host with a third of all
pages is no hot spot; pages are dealt to hosts by a salted key for the same reason.

Input cases: null or empty html has empty text; a null or odd URL counts as one host; repeated
rows are treated alike; an empty table gives an empty result; other columns are ignored; a
page with unclosed or stray tags closes them as browsers mostly do; nothing is cut or capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.session import written

SALTS = 16
"""Parts that the pages of each host are dealt to; its winning path is repeated as often."""
VOTES = 3
"""Paths that one page votes for."""
CLIMB = 0.02
"""Share of text not linked that a container other than article and main adds to one inside it, if it is to be taken instead."""
CLIMB_OUT = 0.2
"""The same where it would leave an article or main."""

# Tags by role.
_RAW = ["script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp"]
_VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
_BLOCKS = [
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]
_CONTAINERS = ["article", "body", "center", "div", "main", "section", "table", "tbody", "td", "tr"]
_SKIPPED = ["aside", "button", "dialog", "footer", "form", "head", "iframe", "math", "menu", "nav", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title", "xmp"]
#: Words of class names, ids and roles that mark what is not main text.
_MARKS = [
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "form", "gdpr", "header", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "promoted",
    "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe",
    "toolbar", "topbar", "widget",
]
#: A start tag of the key closes an open element of the values, up to the nearest container.
_CLOSES = {
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"],
    "option": ["option"], "tbody": ["tbody", "thead", "tr", "td", "th"], "tfoot": ["tbody", "thead", "tr", "td", "th"],
}

_RAW_SET, _VOID_SET, _BLOCK_SET, _BOX_SET, _SKIP_SET, _MARK_SET = map(frozenset, (_RAW, _VOID, _BLOCKS, _CONTAINERS, _SKIPPED, _MARKS))
_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WRAPPERS = frozenset(["has", "with", "no", "is", "js", "without"])
_NAME_PARTS = re.compile(r"[A-Za-z]+")
_SCOPES = frozenset(["table", "ul", "ol", "dl", "select", "article", "section", "div", "main", "body"])


class _Node:
    __slots__ = ("tag", "path", "skip", "main", "start", "own", "below", "links", "headed", "before")

    def __init__(self, tag: str, path: str, skip: bool, main: bool, start: int):
        self.tag, self.path, self.skip, self.main, self.start = tag, path, skip, main, start
        self.own = self.below = self.links = 0
        self.headed = False
        self.before = None  # for an element in doubt: what there was when it began


def _names(attributes: str) -> tuple[str, bool, bool]:
    """Generalised class names, whether a part of a class, id or role marks boilerplate, and whether a whole one does."""
    classes, marked, whole = "", False, False
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        for name in value.lower().split():
            parts = _NAME_PARTS.findall(name)
            # "with-sidebar" or "no-header" tell what a wrapper holds, not what it is
            marked = marked or bool(parts) and parts[0] not in _WRAPPERS and not _MARK_SET.isdisjoint(parts)
            whole = whole or name in _MARK_SET
        if m[1].lower() == "class":
            classes = "".join("." + x for x in sorted(re.sub(r"\d+", "#", c.lower()) for c in value.split()))
    return classes, marked, whole


def parse(html: str) -> tuple[list[str], list[tuple[_Node, int, int]]]:
    """Blocks of text in page order, and each container with its range of blocks."""
    root = _Node("html", "", False, False, 0)
    stack, blocks, found = [root], [], []
    linked: list[int] = []  # characters of each block that are link text
    text: list[str] = []
    link = 0

    def flush() -> None:
        nonlocal link
        if text:
            block = " ".join(unescape("".join(text)).split())
            text.clear()
            if block:
                top = next(x for x in reversed(stack) if x.tag in _BOX_SET or x is root)
                size = len(block)
                top.own += size
                top.links += min(link, size)
                top.headed = top.headed or any(x.tag in ("h1", "h2") for x in stack[-3:])
                blocks.append(block)
                linked.append(min(link, size))
        link = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if node.before and 2 * sum(linked[node.start :]) >= sum(map(len, blocks[node.start :])):
                box, box.own, box.below, box.links, box.headed, kept = node.before
                del blocks[node.start :], linked[node.start :], found[kept:]
            elif node.tag in _BOX_SET and not node.skip:
                found.append((node, node.start, len(blocks)))
                box = next(x for x in reversed(stack) if x.tag in _BOX_SET or x is root)
                box.below += node.own + node.below
                box.links += node.links

    at, end = 0, len(html)
    anchors = 0
    while at < end:
        m = _TAG.search(html, at)
        piece = html[at : m.start() if m else end]
        if piece and not stack[-1].skip:
            text.append(piece)
            if anchors:
                link += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag == "p" and not depth or tag in _BLOCK_SET:
                flush()
            if depth:
                close(depth)
            continue
        block = tag in _BLOCK_SET
        if block:
            flush()
            scope = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in _SCOPES), 0)
            p = next((i for i in range(len(stack) - 1, scope, -1) if stack[i].tag == "p"), 0)
            if p:
                close(p)
            for old in _CLOSES.get(tag, ()):
                i = next((i for i in range(len(stack) - 1, scope, -1) if stack[i].tag == old), 0)
                if i:
                    close(i)
        if tag in _VOID_SET:
            if tag == "br" and not stack[-1].skip:
                text.append(" ")
            continue
        parent = stack[-1]
        classes, marked, whole = _names(m[3]) if m[3] else ("", False, False)
        doubt = marked and not whole and block and parent.main and not parent.skip
        marked = marked and not doubt and (block or whole or not parent.main)
        skip = parent.skip or tag in _SKIP_SET or tag == "header" and not parent.main or marked and tag not in ("html", "body", "article", "main")
        skip = skip or marked and tag == "article" and "comment" in m[3].lower()
        if tag == "a":
            anchors += 1
        if tag in _RAW_SET:
            close_at = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = close_at.end() if close_at else end
            continue
        if m[3].endswith("/") and not block:
            continue
        node = _Node(tag, f"{parent.path}>{tag}{classes}" if tag in _BOX_SET else parent.path, skip, parent.main or tag in ("article", "main"), len(blocks))
        if doubt and not skip:
            box = next(x for x in reversed(stack) if x.tag in _BOX_SET or x is root)
            node.before = (box, box.own, box.below, box.links, box.headed, len(found))
        stack.append(node)
    flush()
    close(1)
    found.append((root, 0, len(blocks)))
    return blocks, found


def score(node: _Node) -> float:
    """Text directly in the container counts whole, text of containers below a quarter, link text is taken off twice."""
    bonus = 1.5 if node.tag in ("article", "main") else 1.0
    return bonus * (node.own + 0.25 * node.below - 2.0 * node.links)


def _best(found: list[tuple[_Node, int, int]]) -> tuple[_Node, int, int]:
    return max(found, key=lambda f: (score(f[0]), -f[1], f[2]))


def _climber(found: list[tuple[_Node, int, int]]):
    """A function from a path to the enclosing path that is taken instead, or the path itself."""
    totals: dict[str, list] = {}
    for node, _, _ in found:
        own = totals.setdefault(node.path, [0, 0, node.tag, False])
        own[0] += node.own + node.below
        own[1] += node.links
        own[3] = own[3] or node.headed

    def climb(path: str, by_share: bool = True) -> str:
        outer, held = path, totals[path][2] in ("article", "main")
        while path:
            path = path.rpartition(">")[0]
            if path not in totals:  # a class name may hold the separator
                continue
            text, links, tag, headed = totals[path]
            more_links = links - totals[outer][1]
            more = text - totals[outer][0] - more_links
            marked = not held and (tag in ("article", "main") or headed and tag not in ("body", "html"))
            if more > 0 and (marked or by_share and more > more_links and more >= (CLIMB_OUT if held else CLIMB) * (totals[outer][0] - totals[outer][1])):
                outer = path
            held = held or tag in ("article", "main")
        return outer

    return climb


def votes_of(html: str) -> list[tuple[str, float]]:
    """What the best paths of a page climb to, each with its share of the page's points."""
    points: dict[str, float] = {}
    found = parse(html)[1]
    for node, _, _ in found:
        if (s := score(node)) > 0:
            points[node.path] = points.get(node.path, 0.0) + s
    top = sorted(points.items(), key=lambda x: (-x[1], x[0]))[:VOTES]
    total = sum(s for _, s in top)
    climb, votes = _climber(found), {}
    for path, s in top:
        outer = climb(path)
        votes[outer] = votes.get(outer, 0.0) + s / total
    return sorted(votes.items(), key=lambda x: (-x[1], x[0]))


def extract(html: str, path: str | None) -> str:
    """The text of the elements on ``path``, or of the page's own best container, with what they climb to."""
    blocks, found = parse(html)
    climb = _climber(found)
    ranges = [(a, b) for node, a, b in found if node.path == path and b > a]
    if ranges:
        outer = climb(path, by_share=False)
        ranges += [(a, b) for node, a, b in found if node.path == outer]
    else:
        best, a, b = _best(found)
        outer = climb(best.path)
        ranges = [(a, b)] + [(x, y) for node, x, y in found if node.path == outer != best.path and x <= a and b <= y]
    taken, upto = [], 0
    for a, b in sorted(ranges):
        taken += blocks[max(a, upto) : b]
        upto = max(upto, b)
    return "\n".join(taken)


def _host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, str], list[float]] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for path, share in votes_of(html or ""):
                own = sums.setdefault((host, path), [0, 0.0])
                own[0] += 1
                own[1] += share
        rows = [(h, p, n, round(s * 1e6)) for (h, p), (n, s) in sums.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "pages", "points"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(html, path) if html else "" for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)]
        yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars", "path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> host, path: the path with the most points of each host, ties to the first by name."""
    votes = pages.select(_host().alias("host"), F.col("html").cast("string")).mapInArrow(_vote, "host string, path string, pages bigint, points bigint")
    sums = votes.groupBy("host", "path").agg(F.sum("points").alias("points"), F.sum("pages").alias("pages"))
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("points")).alias("p"), "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars, path."""
    winners = written(host_paths(pages), "host_paths")
    salted = winners.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    keyed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.col("html").cast("string").alias("html"),
        _host().alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    joined = keyed.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint, path string")
