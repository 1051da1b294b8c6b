"""A small tolerant HTML reader: block elements and text leaves as flat arrays.

Nodes are in page order, so children come after their parent; nothing recurses,
so depth is not limited. Inline markup joins its text to the block around it,
and each run of text between block borders is a leaf. Scripts, styles, the
head and embedded objects leave no text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Elements by their role in the HTML standard.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math canvas audio video select textarea button title head".split())
CLOSED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
# A start tag on the left closes an open one on the right, up to the border.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"})}
# a quote opens a string only where a value begins, after the equals sign
_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))|[^>])*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
LEAF = "#text"


@dataclass
class Dom:
    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)  # words of class, id, role and the like
    text: list[str] = field(default_factory=list)  # of leaves
    linked: list[int] = field(default_factory=list)  # characters of a leaf in links
    marks: list[int] = field(default_factory=list)  # inline tags of a leaf

    def add(self, tag: str, parent: int, attributes: str = "", text: str = "", linked: int = 0, marks: int = 0) -> int:
        for column, value in ((self.tag, tag), (self.parent, parent), (self.attributes, attributes), (self.text, text), (self.linked, linked), (self.marks, marks)):
            column.append(value)
        return len(self.tag) - 1


def _words(raw: str) -> str:
    found = []
    for name, value in _ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop", "name", "data-role", "data-component"):
            found.append(value.strip("\"'"))
        elif name == "hidden" or (name == "aria-hidden" and "true" in value) or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            found.append("hidden")
    return " ".join(found)


def parse(page: str | None) -> Dom:
    dom = Dom()
    root = dom.add("#root", -1)
    stack = [(root, "#root")]
    opened: Counter[str] = Counter()  # how many of each element are on the stack
    pieces: list[tuple[str, bool]] = []
    links = marks = 0

    def flush() -> None:
        nonlocal marks
        if pieces:
            whole = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
            if whole:
                linked = sum(len(html.unescape(t).strip()) for t, a in pieces if a)
                dom.add(LEAF, stack[-1][0], "", whole, min(linked, len(whole)), marks)
            pieces.clear()
        marks = 0

    def close(names: set[str], borders: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][1] in names:
                flush()
                while len(stack) > i:
                    opened[stack.pop()[1]] -= 1
                return
            if stack[i][1] in borders:
                return

    at, page = 0, page or ""
    for m in _TAG.finditer(page):
        if m.start() < at:  # inside raw text
            continue
        if m.start() > at:
            pieces.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                links = 0
                flush()
                if opened[name]:
                    while stack[-1][1] != name:
                        opened[stack.pop()[1]] -= 1
                    opened[stack.pop()[1]] -= 1
            continue
        if name in RAW and name != "head" and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name in ("select", "textarea", "button"):
                marks += 1
            at = end.end() if end else (at if name in ("noscript", "template", "object", "svg", "math", "button", "select") else len(page))
        elif name == "head":
            end = re.compile(r"</head\s*>|<body", re.I).search(page, at)
            if end:
                at = end.start() if end[0].lower() == "<body" else end.end()
        elif name in BLOCKS:
            flush()
            links = 0
            if stack[-1][1] in CLOSED_BY_BLOCK:
                opened[stack.pop()[1]] -= 1
            if name in IMPLIED:
                close(*IMPLIED[name])
            if name in VOID:
                continue
            node = dom.add(name, stack[-1][0], _words(m[3]) if m[3].strip() else "")
            if not m[3].endswith("/") or name in ("p", "div", "li"):
                stack.append((node, name))
                opened[name] += 1
        elif name == "br":
            pieces.append((" ", False))
        else:
            marks += 1
            links += name == "a"
    if at < len(page):
        pieces.append((page[at:], links > 0))
    flush()
    return dom
