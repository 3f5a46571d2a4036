"""A tree-structured graphical model of pages: which nodes are main content.

Every DOM node has a hidden state: ``REST``, ``MAIN``, or ``MIXED`` for elements that hold both.
Its features depend on the state (smoothed counts), and the states of parent and child on each
other (one table for each kind of child and place of the parent).  Sum-product messages go up from the leaves and down from the root, so each node's
marginal weighs all evidence of the page.  Both kinds of potentials are counted on labelled
pages: those whose elements say ``data-main="1"`` or ``"0"`` (the nearest one above counts).
"""

from __future__ import annotations

import math
import random
import re

from tidemark.llm.html_tree import INLINE, Node, parse

_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SMOOTH = 0.5
#: No single piece of evidence counts for more.
_MOST = 20.0
#: Paragraphs and texts of one block are alike, so each counts for a part only.
_DAMP = 0.2
_FLOWING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure dl ol ul li dt dd table tbody tr hr br".split())
_WHOLE = frozenset(("#page", "html", "body"))
_FLOW = frozenset(f"tag {t}" for t in (_FLOWING | INLINE))


def _bucket(n: int) -> str:
    return str(min(12, n.bit_length()))


def _name_words(node: Node) -> set[str]:
    return {w.lower() for a in ("class", "id", "role") for w in _WORD.findall(node.attributes.get(a, ""))}


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of what is seen at each node: tag and names of an element, length, ending and link of a text."""
    in_link = [False] * len(nodes)
    flows = {n.parent for n in nodes if not n.tag or n.tag in _FLOWING}
    found = []
    for k, n in enumerate(nodes):
        if n.tag:
            in_link[k] = n.tag == "a" or (k > 0 and in_link[n.parent])
            names = _name_words(n) if n.attributes else ()
            if n.tag in _WHOLE:
                found.append([f"tag {n.tag} {'flow' if k in flows else 'boxes'}"])
                continue
            own = [f"tag {n.tag} named" if names else f"tag {n.tag}", *(f"name {w}" for w in sorted(names))]
        else:
            link = "link" if in_link[n.parent] else "plain"
            ends = "sentence" if any(c in n.text for c in ".,;!?") else "words"
            own = [f"text {_bucket(len(n.text))} {ends} {link}"]
        found.append(own)
    return found


REST, MAIN, MIXED = range(3)
_STATES = (REST, MAIN, MIXED)
_PLACES = {"#page": "page", "html": "page", "body": "page", "article": "main", "main": "main"}


def tie(nodes: list[Node], k: int) -> str:
    """The table which holds between node ``k`` and its parent."""
    return f"{kind(nodes[k])} {_PLACES.get(nodes[nodes[k].parent].tag, 'other')}"


def kind(node: Node) -> str:
    if not node.tag:
        return "text"
    if node.tag in INLINE:
        return "inline"
    named = any(a in node.attributes for a in ("class", "id", "role"))
    return "flow" if node.tag in _FLOWING and not named else "block"


def labels(nodes: list[Node]) -> list[int | None]:
    """The state of each node of a labelled page; without text it has none."""
    own, size, main = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for k, n in enumerate(nodes):
        mark = n.attributes.get("data-main")
        own[k] = int(mark) if mark in ("0", "1") else (own[n.parent] if k else 0)
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        if not n.tag and n.seen:
            size[k], main[k] = 1, own[k]
        if k:
            size[n.parent] += size[k]
            main[n.parent] += main[k]
    state = [REST if not m else MAIN if m == n else MIXED for m, n in zip(main, size, strict=True)]
    return [x if n else None for x, n in zip(state, size, strict=True)]


def observations(page: str) -> list[tuple[str, int]]:
    """(what, state) of each labelled node: its features, and ``tie table above`` for its parent's state."""
    nodes = parse(page)
    truth, seen = labels(nodes), []
    for k, (own, state) in enumerate(zip(features(nodes), truth, strict=True)):
        if state is None:
            continue
        seen.append(("node" if nodes[k].tag else "piece", state))
        seen += [(f, state) for f in own]
        if k:
            seen.append((f"tie {tie(nodes, k)} {truth[nodes[k].parent]}", state))
    return seen


class PageModel:
    """``counts``: how often each observation was made in each of the three states."""

    def __init__(self, counts: dict[str, tuple[int, int, int]]):
        totals = {name: counts.get(name, (0, 0, 0)) for name in ("node", "piece")}
        self.weight = {}
        for f, seen in counts.items():
            if f.startswith("tie ") or f in totals:
                continue
            rest = totals["piece" if f.startswith("text ") else "node"]
            self.weight[f] = tuple(math.log((n + _SMOOTH) / (r + 2 * _SMOOTH)) for n, r in zip(seen, rest, strict=True))
        self.ties = {}
        for name in ("block", "flow", "inline", "text"):
            for place in ("page", "main", "other"):
                table = []
                for above in _STATES:
                    seen = counts.get(f"tie {name} {place} {above}", (0, 0, 0))
                    smooth = [n + _SMOOTH / 10 for n in seen]
                    table.append(tuple(n / sum(smooth) for n in smooth))
                self.ties[f"{name} {place}"] = tuple(table)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of being content (alone) of each node, given the whole page."""
        weight, belief = self.weight, []
        for own in features(nodes):
            known = [weight[f] for f in own if f in weight]
            a, b, c = (sum(w[x] for w in known) for x in _STATES) if known else (0.0, 0.0, 0.0)
            if own[0].startswith("text ") or own[0] in _FLOW:  # many alike stand in one block, not independent
                a, b, c = a * _DAMP, b * _DAMP, c * _DAMP
            most = max(a, b, c)
            belief.append([math.exp(max(v - most, -_MOST)) for v in (a, b, c)])
        ties = [None, *(self.ties[tie(nodes, k)] for k in range(1, len(nodes)))]
        upward: list = [None] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            a, b, c = belief[k]
            up = [t[0] * a + t[1] * b + t[2] * c for t in ties[k]]
            upward[k] = up
            above = belief[nodes[k].parent]
            x, y, z = above[0] * up[0], above[1] * up[1], above[2] * up[2]
            most = max(x, y, z)
            above[:] = (max(x / most, 1e-250), max(y / most, 1e-250), max(z / most, 1e-250))
        for k in range(1, len(nodes)):
            p, u, t = belief[nodes[k].parent], upward[k], ties[k]
            x, y, z = p[0] / u[0], p[1] / u[1], p[2] / u[2]  # the parent without this child
            own = belief[k]
            own[:] = [own[s] * (t[0][s] * x + t[1][s] * y + t[2][s] * z) for s in _STATES]
            most = max(own)
            own[:] = [max(v / most, 1e-250) for v in own]
        return [b[MAIN] / sum(b) for b in belief]

    def text(self, page: str) -> str:
        """The content blocks in page order, joined by one space."""
        nodes = parse(page)
        chance = self.marginals(nodes)
        blocks, open_block = [], None
        block = [0] * len(nodes)
        fresh = 0
        for k, n in enumerate(nodes):
            if not k:
                continue
            if kind(n) in ("block", "flow"):
                fresh += 1
                block[k] = k
                continue
            block[k] = block[n.parent]
            if not n.tag and n.seen and chance[k] > 0.5:
                # a block goes on until an element which is no inline one begins or ends
                if open_block != (block[k], fresh):
                    blocks.append([])
                    open_block = (block[k], fresh)
                blocks[-1].append(n.text)
        joined = (" ".join("".join(b).split()) for b in blocks)
        return " ".join(b for b in joined if b)


#: Names that page makers give to the parts of a page.
MAIN_NAMES = (
    "content", "post", "entry", "entry-content", "article", "article-body", "story", "story-body", "post-body",
    "main", "main-content", "text", "body-text", "page-content", "blog-post", "hentry",
)
REST_NAMES = {
    "menu": ("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "site-nav", "main-menu", "tabs"),
    "header": ("header", "site-header", "page-header", "masthead", "topbar", "top", "logo", "branding"),
    "footer": ("footer", "site-footer", "page-footer", "copyright", "bottom", "legal", "colophon"),
    "sidebar": ("sidebar", "side", "widget", "aside", "rail", "related", "recommended", "popular", "trending", "tags", "share", "social"),
    "notice": ("notice", "cookie", "cookies", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "warning", "message", "disclaimer", "paywall", "overlay"),
    "advert": ("ad", "ads", "advert", "advertisement", "banner", "promo", "promotion", "sponsor", "sponsored", "adsense", "ad-slot"),
    "form": ("form", "search", "login", "signup", "subscribe", "newsletter", "contact-form", "comment-form"),
    "comments": ("comments", "comment", "comment-list", "discussion", "replies", "reply", "responses", "disqus", "user-comments", "feedback"),
}
_TAGS = {
    "menu": ("nav", "div", "ul", "nav"), "header": ("header", "div", "header"), "footer": ("footer", "div", "footer"),
    "sidebar": ("aside", "div", "section", "aside"), "notice": ("div", "section", "aside"), "advert": ("div", "aside", "section", "ins"),
    "form": ("form", "div", "form"), "comments": ("section", "div", "ol", "ul"),
}


def _sentence(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
    for k in range(6, len(words), 7):
        words[k] += rng.choice((",", ".", "."))
    return (" ".join(words)).capitalize() + rng.choice((".", ".", ".", "!", "?", ""))


def _links(rng: random.Random, n: int, listed: bool) -> str:
    one = "<li><a href='/x'>{}</a></li>" if listed else "<a href='/x'>{}</a> "
    made = "".join(one.format(_sentence(rng, 1, 4).rstrip(".!?")) for _ in range(n))
    return f"<ul>{made}</ul>" if listed else made


def _rest(rng: random.Random, part: str) -> str:
    tag, name = rng.choice(_TAGS[part]), rng.choice(REST_NAMES[part])
    plain = rng.random() < 0.4 and tag in ("nav", "header", "footer", "aside", "form")
    attribute = "" if plain else rng.choice((' class="{}"', ' id="{}"', ' class="x {}"', ' class="{}" role="region"')).format(name)
    if part == "menu":
        inner = _links(rng, rng.randint(2, 8), rng.random() < 0.7)
    elif part == "header":
        inner = rng.choice(("<h1>{}</h1>", "<a href='/'>{}</a>", "<div>{}</div>", "<p>{}</p>")).format(_sentence(rng, 1, 8))
        inner += _links(rng, rng.randint(0, 4), rng.random() < 0.5)
    elif part == "footer":
        inner = rng.choice(("{}", "<p>{}</p>", "&copy; {}")).format(_sentence(rng, 2, 25)) + _links(rng, rng.randint(0, 4), rng.random() < 0.4)
    elif part == "sidebar":
        inner = f"<h3>{_sentence(rng, 1, 4)}</h3>" + rng.choice((_links(rng, rng.randint(2, 6), True), f"<p>{_sentence(rng, 4, 40)}</p>"))
    elif part in ("notice", "advert"):
        inner = rng.choice(("{}", "<p>{}</p>", "<span>{}</span> <a href='/y'>more</a>", "<p>{}</p><button>OK</button>")).format(_sentence(rng, 3, 30))
    elif part == "form":
        inner = f"<label>{_sentence(rng, 1, 4)}</label><input name='q'>" + rng.choice(("", f"<p>{_sentence(rng, 3, 20)}</p>")) + "<button>Go</button>"
    else:
        wrap = rng.choice(("<div class='comment'><p>{}</p></div>", "<li class='comment'><b>{n}</b> <p>{}</p></li>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>", "<div class='reply'><span class='author'>{n}</span>{}</div>"))
        inner = rng.choice(("", "<h2>Comments</h2>", "<h3>Replies</h3>"))
        inner += "".join(wrap.format(_sentence(rng, 3, 60), n=_sentence(rng, 1, 2)) for _ in range(rng.randint(1, 6)))
    return f'<{tag}{attribute} data-main="0">{inner}</{tag}>'


def labelled_page(number: int, seed: int = 11) -> str:
    """A made page whose parts say whether they are content; one of many layouts, the same for a number."""
    rng = random.Random(f"{seed}-{number}")
    blocks = [rng.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "")).format(_sentence(rng, 2, 10))]
    for _ in range(rng.choice((1, 1, 2, 4, 7, 12))):
        text = _sentence(rng, *rng.choice(((1, 5), (3, 15), (8, 40), (20, 120), (60, 250))))
        if rng.random() < 0.25:
            text += f" <a href='/z'>{_sentence(rng, 1, 4)}</a> <b>{_sentence(rng, 1, 6)}</b>"
        shape = rng.choice(("<p>{}</p>",) * 9 + ("<p>{}", "<p><b>{}<br>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<h3>{}</h3>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>"))
        blocks.append(shape.format(text))
        if rng.random() < 0.12:
            blocks.append(_rest(rng, rng.choice(("advert", "sidebar", "form", "notice", "menu"))))
    main = "".join(blocks)
    if rng.random() < 0.15:
        main += _rest(rng, "comments")
    tag = rng.choice(("article",) * 5 + ("main", "main", "div", "div", "div", "section", "td"))
    name = "" if tag in ("article", "main") and rng.random() < 0.6 else f' class="{rng.choice(MAIN_NAMES)}"' if rng.random() < 0.85 else ""
    main = f'<{tag}{name} data-main="1">{main}</{tag}>'
    for _ in range(rng.choice((0, 0, 1, 2))):
        main = rng.choice(("<div>{}</div>", '<div class="container">{}</div>', '<div id="wrapper">{}</div>', "<main>{}</main>", '<div class="row">{}</div>')).format(main)
    before = [_rest(rng, p) for p in ("notice", "header", "menu", "advert", "form") if rng.random() < 0.5]
    after = [_rest(rng, p) for p in ("comments", "sidebar", "advert", "footer") if rng.random() < 0.5]
    head = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head>"
    if rng.random() < 0.1:  # no element holds the content alone
        return f'{head}<body data-main="1">{"".join(before)}{"".join(blocks)}{"".join(after)}</body></html>'
    return f"{head}<body>{''.join(before)}{main}{''.join(after)}</body></html>"
