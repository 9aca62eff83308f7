"""One tolerant pass over an HTML body: title, metadata, hrefs and the main text.

Runs inside Arrow-batched tasks, one page at a time; everything relational
(resolving, filtering, deduplicating links) happens afterwards in column
expressions.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from typing import NamedTuple

_NAME = r"[^\s/<>][^\s/<>=]*+"
_VALUE = r"""\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+"""
_ATTRS = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE})?)?+")
_ATTR_LIST = rf"(?:[\s/]*+{_NAME}(?:\s*+=\s*+(?:{_VALUE})?)?+)*+"
_NOT_TAG = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
_TOKEN = re.compile(rf"{_NOT_TAG}|<(/?)([a-zA-Z][^\s/>]*+)({_ATTR_LIST})[\s/]*+>", re.S)

# Elements whose content is text, never markup.
_RAW_TEXT = ["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"]

# The same tokens in one expression that only reports the attributes of links.
_LINK_TOKEN = re.compile(
    rf"{_NOT_TAG}|<(?i:({'|'.join(_RAW_TEXT)}))(?=[\s/>]){_ATTR_LIST}[\s/]*+>.*?(?:</(?i:\1)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    rf"|<[aA](?=[\s/>])({_ATTR_LIST})[\s/]*+>|</?[a-zA-Z][^\s/>]*+{_ATTR_LIST}[\s/]*+>",
    re.S,
)

# Elements that end a run of text.
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CHROME = {"aside", "dialog", "footer", "form", "header", "nav"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES_P = _BLOCKS - {"html", "body"}
_SELF_CLOSING_PEERS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}

# Starting weight of a container by its tag.
_TAG_WEIGHT = {
    **dict.fromkeys(["article", "main"], 10.0),
    **dict.fromkeys(["div", "section"], 5.0),
    **dict.fromkeys(["pre", "td", "blockquote"], 3.0),
    **dict.fromkeys(["address", "ol", "ul", "dl", "dd", "dt", "li", "form"], -3.0),
    **dict.fromkeys(["h1", "h2", "h3", "h4", "h5", "h6", "th"], -5.0),
}
_UNLIKELY = re.compile(
    r"\b(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookie|footer|menu|modal|nav\w*|popup|promo|related|share|"
    r"sidebar|skyscraper|social|sponsor\w*|toolbar|widget)\b",
    re.I,
)
_LIKELY = re.compile(r"\b(?:article|body|content|entry|main|page|post|story|text)\b", re.I)

_DESCRIPTION_KEYS = ["description", "og:description", "twitter:description", "dc:description"]
# weights of the score, not limits of what is taken: shorter lines give no points, and only so many ancestors get some
_MIN_PARAGRAPH = 25
_SCORED_ANCESTORS = 5


class Parsed(NamedTuple):
    title: str
    description: str
    content: str
    hrefs: list[str]


class _Box:
    """A block-level element: its place in the tree and what was counted below it."""

    __slots__ = ("chars", "dropped", "link_chars", "parent", "score", "tag")

    def __init__(self, tag: str, names: str, parent: _Box | None):
        self.tag = tag
        self.parent = parent
        unlikely = bool(names) and bool(_UNLIKELY.search(names)) and not _LIKELY.search(names)
        self.dropped = tag in _CHROME or unlikely or (parent is not None and parent.dropped)
        self.score: float | None = None
        self.chars = 0
        self.link_chars = 0

    def add_paragraph(self, text: str) -> None:
        gain = 1.0 + text.count(",") + min(len(text) // 100, 3)
        box, level = self.parent, 0
        while box is not None and level < _SCORED_ANCESTORS:
            if box.score is None:
                box.score = _TAG_WEIGHT.get(box.tag, 0.0)
            box.score += gain / (1 if level == 0 else 2 if level == 1 else level * 3)
            box, level = box.parent, level + 1

    def rank(self) -> float:
        return (self.score or 0.0) * (1.0 - self.link_chars / max(self.chars, 1))


_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*;?)(?!=))")


def _attribute_text(value: str) -> str:
    """Decode character references as in attributes, where ``&copy=1`` is a parameter and not a sign."""
    return _REFERENCE.sub(lambda m: html5.get(m.group(1), m.group()) if m.group(1) else unescape(m.group()), value)


def _attributes(source: str) -> list[tuple[str, str]]:
    out = []
    for name, value in _ATTRS.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.append((name.lower(), _attribute_text(value) if "&" in value else value))
    return out


def find_hrefs(body: str) -> list[str]:
    """Only the hrefs of ``parse_html``."""
    return [v for _, attrs in _LINK_TOKEN.findall(body) if attrs for k, v in _attributes(attrs) if k == "href" and v]


def parse_html(body: str) -> Parsed:
    title: str | None = None
    metas: dict[str, str] = {}
    hrefs: list[str] = []
    lines: list[tuple[_Box, str]] = []
    root = _Box("html", "", None)
    open_boxes = [root]
    buffer: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        buffer.clear()
        box = open_boxes[-1]
        if text:
            box.chars += len(text)
            box.link_chars += min(linked, len(text))
            if not box.dropped and box.tag not in ("html", "body"):
                lines.append((box, text))
                if len(text) >= _MIN_PARAGRAPH and box.tag not in _HEADINGS:
                    box.add_paragraph(text)
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            buffer.append(text)
            if in_link:
                linked += len(text)

    def shut(depth: int) -> None:
        # counts go up once, when a box is done
        while len(open_boxes) > depth:
            box = open_boxes.pop()
            open_boxes[-1].chars += box.chars
            open_boxes[-1].link_chars += box.link_chars

    def close(tags: set[str]) -> None:
        for depth in range(len(open_boxes) - 1, 0, -1):
            if open_boxes[depth].tag in tags:
                shut(depth)
                return

    position, end = 0, len(body)
    while position < end:
        token = _TOKEN.search(body, position)
        if token is None:
            take(body[position:])
            break
        take(body[position : token.start()])
        position = token.end()
        if token.group(2) is None:
            continue
        tag, closing = token.group(2).lower(), token.group(1) == "/"
        if tag in _RAW_TEXT and not closing:
            stop = re.compile(r"</" + tag + r"(?=[\s/>])[^>]*+(?:>|\Z)|\Z", re.I).search(body, position)
            if tag == "title" and title is None:
                title = " ".join(unescape(body[position : stop.start()]).split())
            position = max(stop.end(), position)
        elif tag == "a":
            in_link = 0 if closing else 1
            if not closing:
                hrefs.extend(v for k, v in _attributes(token.group(3)) if k == "href" and v)
        elif tag == "meta" and not closing:
            found = dict(_attributes(token.group(3)))
            key = (found.get("name") or found.get("property") or "").lower()
            if key and found.get("content"):
                metas.setdefault(key, found["content"])
        elif tag == "br":
            flush()
        elif tag in _BLOCKS:
            flush()
            if closing:
                close({tag})
                continue
            if tag in _CLOSES_P and open_boxes[-1].tag == "p":
                shut(len(open_boxes) - 1)
            if open_boxes[-1].tag in _SELF_CLOSING_PEERS.get(tag, ()):
                shut(len(open_boxes) - 1)
            names = ""
            if "class" in token.group(3) or "id" in token.group(3):
                names = " ".join(v for k, v in _attributes(token.group(3)) if k in ("class", "id"))
            if tag not in ("hr", "html"):
                open_boxes.append(_Box(tag, names, open_boxes[-1]))
    flush()
    shut(1)

    if not lines:
        return Parsed("", "", "", hrefs)
    best, met = root, set()
    for box, _ in lines:
        walk = box.parent
        while walk is not None and id(walk) not in met:
            met.add(id(walk))
            if walk.score is not None and (best.score is None or walk.rank() > best.rank()):
                best = walk
            walk = walk.parent
    within: dict[int, bool] = {id(best): True}
    kept = []
    for box, text in lines:
        path, walk = [], box
        while walk is not None and id(walk) not in within:
            path.append(id(walk))
            walk = walk.parent
        inside = walk is not None and within[id(walk)]
        within.update(dict.fromkeys(path, inside))
        if inside:
            kept.append((box, text))
    description = next((metas[k] for k in _DESCRIPTION_KEYS if k in metas), None)
    if description is None:
        description = next((t for b, t in kept if b.tag not in _HEADINGS), kept[0][1])
    return Parsed(title or "", " ".join(description.split()), "\n".join(t for _, t in kept), hrefs)
