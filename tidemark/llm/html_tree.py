"""A forgiving HTML reader: a flat list of nodes, parents before children."""

from __future__ import annotations

import html
import re

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.DOTALL,
)
#: A tag with a quote that never closes ends at the first bracket.
_BROKEN = re.compile(r"<(/?)([A-Za-z][^\s/>\"']*)([^>]*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Groups of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript noframes iframe xmp template".split())
UNSEEN = RAW | frozenset("head select option optgroup datalist button object svg math audio video canvas map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements which end an open one of the same group, up to the boundary that holds them.
_SIBLINGS = {
    **{t: (("li",), ("ul", "ol", "menu")) for t in ("li",)},
    **{t: (("dt", "dd"), ("dl",)) for t in ("dt", "dd")},
    **{t: (("td", "th"), ("tr", "table")) for t in ("td", "th")},
    "tr": (("tr", "td", "th"), ("table",)),
    **{t: (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)) for t in ("tbody", "thead", "tfoot")},
    "option": (("option",), ("select",)),
}
_SCOPE = frozenset("html body article aside div section main table td th form blockquote li nav header footer".split())


class Node:
    """An element, or with ``tag`` empty a piece of text."""

    __slots__ = ("tag", "parent", "attributes", "text", "seen")

    def __init__(self, tag: str, parent: int, attributes: dict[str, str], text: str, seen: bool):
        self.tag, self.parent, self.attributes, self.text, self.seen = tag, parent, attributes, text, seen


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


_START = re.compile(r"<[!?/A-Za-z]")


def _next_markup(page: str, at: int) -> re.Match | None:
    while start := _START.search(page, at):
        found = _MARKUP.match(page, start.start()) or _BROKEN.match(page, start.start())
        if found:
            return found
        at = start.start() + 1
    return None


def parse(page: str) -> list[Node]:
    """The nodes in page order; node 0 stands for the page.  Any string gives a tree."""
    nodes = [Node("#page", -1, {}, "", True)]
    path = [0]  # open elements
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the path

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            nodes.append(Node("", path[-1], {}, html.unescape(piece), nodes[path[-1]].seen))

    def close(tags, stop) -> None:
        """Closes the innermost open element among ``tags``, unless one of ``stop`` stands above it."""
        found = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if found > max((places[t][-1] for t in stop if places.get(t) and t not in tags), default=0):
            for k in path[found:]:
                places[nodes[k].tag].pop()
            del path[found:]

    at = 0
    while found := _next_markup(page, at):
        text(page[at : found.start()])
        at = found.end()
        closing, tag = found[1], (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                text(found[0][9:].removesuffix("]]>"))
            continue
        if closing:
            if tag not in VOID:
                close((tag,), ("td", "th", "table") if tag in INLINE or tag == "p" else ())
            continue
        if tag in _ENDS_P:
            close(("p",), _SCOPE)
        if tag in _SIBLINGS:
            close(*_SIBLINGS[tag])
        if tag == "body":
            close(("head",), ())
        parent = path[-1]
        attributes = _attributes(found[3]) if found[3] else {}
        hidden = "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        nodes.append(Node(tag, parent, attributes, "", nodes[parent].seen and tag not in UNSEEN and not hidden))
        if tag in RAW and not found[3].endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
        if tag not in VOID and not found[3].endswith("/"):
            places.setdefault(tag, []).append(len(path))
            path.append(len(nodes) - 1)
    text(page[at:])
    return nodes
