"""HTML extraction by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf tag path. Nodes of one path are
counted together: how much text and how much punctuation the path holds for each of its nodes.
Both ratios are smoothed along the page, fused by their product, and the paths above a
threshold are content. Names of elements, and whether a path lies in an article, only weigh; menus,
forms' parts and the like, which never hold an article's text, are set aside first.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import map_column

#: Elements whose content is markup's own, never text: skipped to their end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select"}
#: Elements set aside with all they hold.
ASIDE = {
    "nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset",
    "input", "option", "optgroup", "datalist", "canvas", "audio", "video", "map", "applet", "embed", "frameset",
}
#: Elements that hold text of their own kind. In the article they stay, however short, unless they are lists of links.
HOLDING = {"p", "td", "th", "li", "dt", "dd", "pre", "blockquote", "figcaption", "caption", "summary", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Words that an element's id, class or role begins or ends with, and that make it weigh little, whatever the others are,
#: but for those that say that something is there, or is not.
STRONG_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "comment", "comments", "responses", "cookie", "cookies", "newsletter"}
DENYING_NAMES = {"has", "no", "with", "without", "not", "is", "non", "hide", "layout", "view", "paper"}
#: Words in an element's id, class or role that make it weigh little. A name counts if it has no word but these and PLAIN_NAMES.
ASIDE_NAMES = STRONG_NAMES | {
    "banner", "replies", "discussion", "reactions", "feedback",
    "consent", "notice", "notices", "alert", "popup", "modal", "subscribe", "signup", "login", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "related", "recommended", "footer", "header", "masthead", "share",
    "social", "search", "pagination", "toc",
}
#: Words that say of what or where a named part is, and nothing of what it holds.
PLAIN_NAMES = {
    "site", "page", "main", "top", "bottom", "left", "right", "section", "list", "box", "block", "wrapper", "container", "area", "item", "bar",
    "links", "post", "article", "reader", "user",
}
#: The share of its score that a path keeps: inside an element so named, outside the article, and as a path of links only.
NAMED, OUTSIDE, LINKS = 0.05, 0.1, 0.05
#: An article frames the page if it has this share of the weighed text, or so many characters and a smaller share.
FRAME_SHARE, FRAME_CHARS, FRAME_LEAST = 0.3, 100, 0.05
#: From this share of linked text on, a path in the article is one of links and is not kept for its kind.
LINK_LIST = 0.8
#: Elements that never have content of their own.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements inside a line: they neither begin nor end a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
    "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: A start tag of the left closes an open element of the right, up to the nearest barrier.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BARRIER = {"ul", "ol", "dl", "table", "body", "article", "section", "div", "main", "blockquote"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[A-Za-z][^>]*(?:>|\Z)",
    re.S,
)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_MARKS = re.compile(r"""(?:^|[\s"'/])(?:id|class|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_closing = cache(lambda name: re.compile(rf"</{name}\s*[^>]*>", re.I))
_PUNCTUATION = re.compile(r"[,.;:!?，。；：！？、]")
_SPACE = re.compile(r"\s+")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


class Node:
    """A block of text: the number of its tag path, its parts, and the innermost element of each kind that it lies in."""

    __slots__ = ("aside", "heading", "holding", "linked", "link_parts", "main", "parts", "path", "text", "weight")

    def __init__(self, path: int, aside: int, main: int, heading: bool, holding: bool) -> None:
        self.path, self.aside, self.main, self.heading, self.holding = path, aside, main, heading, holding
        self.parts, self.link_parts, self.linked, self.text, self.weight = [], [], 0, "", 1.0

    def close(self) -> bool:
        """Makes the text from the parts; whether there is any."""
        self.text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        self.linked = min(len(self.text), sum(len(_SPACE.sub(" ", html.unescape(x)).strip()) for x in self.link_parts))
        return self.text != ""


def _named(tag: str) -> bool:
    """Whether an element's id, class or role says that it holds something else than the article."""
    for named in " ".join(m.strip("\"'") for m in _MARKS.findall(tag)).split():
        listed = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower())
        words = set(listed)
        if words & ASIDE_NAMES and words <= ASIDE_NAMES | PLAIN_NAMES:
            return True
        if listed and not words & DENYING_NAMES and (listed[0] in STRONG_NAMES or listed[-1] in STRONG_NAMES):
            return True
    return False


class _Open:
    """An open element, with what holds for all that it contains."""

    __slots__ = ("aside", "heading", "hidden", "main", "name", "path")

    def __init__(self, name: str, path: int, aside: int, main: int, heading: bool, hidden: bool) -> None:
        self.name, self.path, self.aside, self.main, self.heading, self.hidden = name, path, aside, main, heading, hidden


class _Stack:
    """The open elements, outermost first. Where the innermost of a name, block or barrier stands is known at once,
    so that the time for a tag does not depend on how deep it lies."""

    def __init__(self) -> None:
        self.held = [_Open("", 0, 0, 0, False, False)]
        self.at: dict[str, list[int]] = {}
        self.blocks, self.barriers = [0], [0]

    def last(self, name: str) -> int:
        return (self.at.get(name) or [0])[-1]

    def push(self, element: _Open) -> None:
        i = len(self.held)
        self.held.append(element)
        self.at.setdefault(element.name, []).append(i)
        if element.name not in INLINE:
            self.blocks.append(i)
        if element.name in BARRIER:
            self.barriers.append(i)

    def cut(self, i: int) -> bool:
        """Closes all elements from position ``i`` on; whether a block was among them."""
        while len(self.held) > i:
            self.at[self.held.pop().name].pop()
        block = self.blocks[-1] >= i
        for positions in (self.blocks, self.barriers):
            while positions[-1] >= i:
                positions.pop()
        return block


class _Asides:
    """The elements of a page that are set aside or weigh little, by number, each with the one around it."""

    def __init__(self) -> None:
        self.around, self.factor, self.inside_main = [0], [1.0], [0]

    def add(self, around: int, factor: float, main: int) -> int:
        self.around.append(around)
        self.factor.append(factor)
        self.inside_main.append(main)
        return len(self.around) - 1

    def weights(self, nodes: list[Node], mains: list[tuple[int, int]]) -> list[float]:
        """The weight of what lies in each: the product down to it, without those that hold the article after all.

        That is the ``article`` or ``main`` (a list of the aside and the main around each) of most text, if
        all lie in asides or if it has most of the page's text. Without any, an aside with most of the text.
        """
        total, held, inner = 0, [0] * len(self.around), [0] * len(mains)
        for n in nodes:
            total += len(n.text)
            held[n.aside] += len(n.text)
            inner[n.main] += len(n.text)
        for i in range(len(held) - 1, 0, -1):
            held[self.around[i]] += held[i]
        for i in range(len(inner) - 1, 0, -1):
            inner[mains[i][1]] += inner[i]
        spared = set()
        if len(mains) > 1:
            best = max(range(1, len(mains)), key=lambda m: (inner[m], -m))
            if 2 * inner[best] > total or all(aside for aside, _ in mains[1:]):
                at = mains[best][0]
                while at:
                    spared.add(at)
                    at = self.around[at]
        else:
            spared = {i for i in range(1, len(held)) if 2 * held[i] > total and self.factor[i] >= NAMED}
        weight = [1.0] * len(held)
        for i in range(1, len(held)):
            weight[i] = weight[self.around[i]] * (1.0 if i in spared else self.factor[i])
        return weight


def blocks(page: str) -> list[Node]:
    """The page's non-empty blocks of text with their weights, in order; those set aside weigh 0.

    Unclosed elements end where an outer one does. Time is in proportion to the page's length.
    """
    stack, asides = _Stack(), _Asides()
    mains: list[tuple[int, int]] = [(0, 0)]
    paths: dict[tuple[int, str], int] = {}
    found: list[Node] = []
    node: Node | None = None
    at, end = 0, len(page)

    def put(raw: str) -> None:
        nonlocal node
        if not raw:
            return
        inner = stack.held[-1]
        if node is None:
            if raw.isspace() or inner.hidden:
                return
            node = Node(inner.path, inner.aside, inner.main, inner.heading, stack.held[stack.blocks[-1]].name in HOLDING)
            found.append(node)
        node.parts.append(raw)
        if stack.last("a"):
            node.link_parts.append(raw)

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at, tag = m.end(), m.group()
        if tag.startswith("<![CDATA["):
            put(html.escape(tag[9:-3] if tag.endswith("]]>") else tag[9:]))
            continue
        name = _NAME.match(tag)
        if name is None:
            continue
        name = name.group(1).lower()
        inline = name in INLINE
        if tag[1] == "/":
            opened = stack.last(name)
            if inline and opened < stack.blocks[-1]:
                continue  # an inline end tag reaches no further than its block
            aside = stack.held[-1].aside
            if not inline or (opened and stack.held[opened].aside != stack.held[opened - 1].aside):
                node = None
            if opened and (stack.cut(opened) or aside != stack.held[-1].aside):
                node = None
            continue
        if name == "br":
            put(" ")
            continue
        if not inline:
            node = None
        if name in RAW and not tag.endswith("/>"):
            close = _closing(name).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID:
            continue
        if name in CLOSES:
            opened = max(stack.last(n) for n in CLOSES[name])
            if opened > stack.barriers[-1]:
                stack.cut(opened)
        elif not inline and stack.last("p") > stack.barriers[-1]:
            stack.cut(stack.last("p"))  # a block ends an open paragraph, and what that holds
        if tag.endswith("/>"):
            continue
        inner = stack.held[-1]
        main, aside, marked = inner.main, inner.aside, name
        hidden = inner.hidden or ("hidden" in tag or "display" in tag) and _HIDDEN.search(tag) is not None
        if name in ("article", "main"):
            mains.append((aside, main))
            main = len(mains) - 1
        elif name == "header" and main:
            aside, marked = asides.add(aside, NAMED, main), name + "!"  # an article's own, whose headings count
        elif name in ASIDE:
            aside, marked = asides.add(aside, NAMED if name == "form" else 0.0, main), name + "!"
        elif "=" in tag and name not in ("body", "html") and _named(tag):
            aside, marked = asides.add(aside, NAMED, main), name + "!"
        if aside != inner.aside:
            node = None
        path = inner.path if inline and marked == name else paths.setdefault((inner.path, marked), len(paths) + 1)
        stack.push(_Open(name, path, aside, main, inner.heading or name in HEADINGS, hidden))
    shown = [n for n in found if n.close()]
    weights = asides.weights(shown, mains)
    for n in shown:
        n.weight = weights[n.aside]
        if n.heading and n.aside and n.main and asides.inside_main[n.aside] == n.main and n.weight == NAMED:
            n.weight = 1.0
    return shown


def _smooth(values: np.ndarray) -> np.ndarray:
    """A Gaussian over two neighbours on each side, within the page."""
    kernel = np.exp(-(np.arange(-2, 3) ** 2) / 2.0)
    padded = np.pad(values, 2, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def content(page: str | None, keep: float = 0.25) -> list[str]:
    """The content blocks of a page.

    A path's ratios are its text and its punctuation for each of its nodes; both are smoothed
    along the page and fused. A path is content if that score, by the path's weight, is at least ``keep`` of
    the mean over the page's text. What is named like something else than an article, and what lies outside the
    ``article`` or ``main`` that holds the text, weighs little; elements such as menus weigh nothing. In the article
    the ratios decide on what lies in ``div`` and the like, and on lists of links; paragraphs, cells, items, captions,
    quotations and code stay. Without an article a path's own ratios count as much as the smoothed ones, links and lines of
    rights weigh little, and headings before the last content block go with it.
    """
    nodes = [n for n in blocks(page or "") if n.weight > 0]
    if not nodes:
        return []
    paths = {p: i for i, p in enumerate(dict.fromkeys((n.path, n.weight) for n in nodes))}
    which = np.array([paths[n.path, n.weight] for n in nodes])
    length = np.array([len(n.text) for n in nodes], float)
    linked = np.array([n.linked for n in nodes], float)
    marks = np.array([len(_PUNCTUATION.findall(n.text)) for n in nodes], float)
    weight = np.array([n.weight for n in nodes])
    within = np.array([bool(n.main) for n in nodes])
    weighed, inner = length * weight, (length * weight)[within].sum()
    framed = inner > FRAME_SHARE * weighed.sum() or (inner >= FRAME_CHARS and inner > FRAME_LEAST * weighed.sum())
    share = (np.bincount(which, linked) / np.bincount(which, length))[which]
    if framed:
        sheltered = within & (weight == 1.0) & np.array([n.holding for n in nodes]) & (share < LINK_LIST)
        weight = weight * np.where(within, 1.0, OUTSIDE)
    else:
        sheltered = np.zeros(len(nodes), bool)
        # links lead elsewhere where no article says that they are part of it
        weight = weight * np.maximum(1.0 - share, LINKS) * np.where([_RIGHTS.match(n.text) is not None for n in nodes], NAMED, 1.0)
    per_path = np.bincount(which)
    text_ratio, mark_ratio = (np.bincount(which, length) / per_path)[which], (np.bincount(which, marks) / per_path)[which]
    fused = _smooth(text_ratio) * (1.0 + _smooth(mark_ratio))
    if not framed:
        fused = np.sqrt(fused * text_ratio * (1.0 + mark_ratio))
    fused = np.sqrt(fused) * weight
    path_score = np.bincount(which, fused) / per_path
    good = path_score >= keep * float((fused * length).sum() / length.sum())
    if not good.any():
        good = path_score >= path_score.max()
    good[which[sheltered]] = True
    first, last = np.flatnonzero(good[which])[[0, -1]]
    chosen = weight >= weight[good[which]].min()
    led = np.array([n.heading for n in nodes]) & chosen & (np.arange(len(nodes)) < last)
    return [n.text for i, n in enumerate(nodes) if good[which[i]] or (led[i] and (within[i] or i >= first - 3))]


def extract(pages: DataFrame, html_column: str = "html", kept: list[str] | None = None) -> DataFrame:
    """Every row's ``kept`` columns with text and n_chars (its code points).

    text is the page's content blocks in order, joined by newlines; white space inside a block is one
    space, character references are decoded. Null and empty pages and pages without content
    give an empty text and 0. Text without any markup is one block. Equal rows give equal rows.
    """

    def make(pages: list[str | None]) -> dict:
        texts = ["\n".join(content(p)) for p in pages]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")] if kept is None else kept
    return map_column(pages, kept, F.col(html_column), make, "text string, n_chars bigint")
