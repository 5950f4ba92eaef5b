"""Main text of web pages from streamed parser events.

The standard library's parser yields tags and text. Text is gathered into lines (one for each block
of the page) with the number of tags since the line before. Elements that hold no article's text, such as scripts, menus, forms and asides, are left out. The
text-to-tag ratio of the lines is smoothed by a Gaussian and cut at a threshold. All lines above it are the article, wherever they stand, and so are
the short lines of the regions, which are the elements that hold the dense lines. Names like article and main
say only how far a region reaches.

Names of adverts, menus, comments and the like weigh: a line in such an element needs a ratio eight times (words of layout) or four times (words that may be a
topic as well) as high. Inside an article or content element a topic's word counts for nothing but that the element's short lines stay only beside a dense
one; an element named for discussion is one of reader comments there only if it repeats: if it has a form, or several parts with such a name. Where
by density all content stands in elements with such names, they are ignored.

Lines of links only, in a row or several in a line, are menus unless they stand in an article or between dense lines of their own element.

Defined results: null html, empty html and pages without text give an empty text; repeated rows get
equal rows; pages of any length are read whole.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furrow.llm.common import append_columns, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead"
    " title tr ul".split()
)
#: Elements whose text is no article wherever they stand.
OUTSIDE = frozenset(
    "head title script style noscript template nav aside footer form button select option textarea label fieldset dialog iframe object"
    " embed svg canvas math audio video map menu datalist".split()
)
#: Elements that a start tag of the key closes, up to the nearest of the barrier.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words in a class, id or role that stand for layout about an article, and words that may be an article's topic as well.
LAYOUT_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs cookie cookies consent contentinfo complementary copyright"
    " dialog alertdialog footer gdpr header masthead menu menubar modal nav navbar navigation newsletter overlay pagination paywall popup rail"
    " sidebar skip sponsor sponsored subscribe toolbar widget".split()
)
TOPIC_WORDS = frozenset("alert form login notice notices notification promo promotion recommended related search share sharing signup social teaser".split())
#: Words of reader comments, and those of them that are a topic in an article unless they repeat there.
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond discussion".split())
TALK_WORDS = frozenset("comment reply respond discussion".split())
#: Words that mark the article, so that those of layout and topics in the same element count for nothing; and those of them in whose elements topics do.
ARTICLE_WORDS = frozenset("article content entry main post story text body page wrapper container layout".split())
CONTENT_WORDS = frozenset("article content entry post story text".split())
#: What a line's ratio is multiplied by.
LAYOUT_WEIGHT, TOPIC_WEIGHT = 1 / 8, 1 / 4
#: Parts with names of comments from which an element in an article is one of comments.
REPEATS = 2
#: Elements that hold one line, and so are no region.
SINGLE = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr span b i em strong a pre blockquote".split())
#: Elements that hold menus as well as text: a region only if dense lines stand in them directly.
PAGE = frozenset(("#root", "html", "body"))
_OPENED = re.compile(r"<[A-Za-z/!?]")
_WORDS = re.compile(r"[a-z]+")
_LETTER = re.compile(r"\w")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Node:
    """An open element that may hold the region."""

    __slots__ = ("tag", "parent", "outside", "weight", "topic", "talk", "content", "named", "dense", "kids", "names", "inside", "article")

    def __init__(self, tag: str, parent: "_Node | None", outside: bool = False, named: bool = False, content: bool = False):
        self.tag, self.parent, self.outside, self.named = tag, parent, outside, named
        self.article = named or (parent is not None and parent.article)
        self.content = named or content or (parent is not None and parent.content)
        # what names weigh; the topmost element in an article that has a topic's name; how much of comments the topmost discussion has
        self.weight: float = parent.weight if parent else 1.0
        self.topic: _Node | None = parent.topic if parent else None
        self.talk: list[int] | None = parent.talk if parent else None
        # dense lines of its own; elements in it that hold some; whether a named one does
        self.dense, self.kids, self.names, self.inside = False, [], False, False

    def set_aside(self) -> bool:
        return self.weight < 1 or (self.talk is not None and self.talk[0] >= REPEATS)


class _Line:
    """Text of a block, tags so far and since the line before, the element that holds it, and how many links hold all of it (0: not all)."""

    __slots__ = ("text", "at", "tags", "node", "links")

    def __init__(self, text: str, at: int, node: _Node, links: int):
        self.text, self.at, self.tags, self.node, self.links = text, at, at, node, links


class Lines(HTMLParser):
    """The page as lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", None)
        self.open: list[_Node] = [self.root]
        self.nodes: list[_Node] = [self.root]  # parents before children
        self.count: dict[str, int] = {}
        #: Text of the block so far: what it is, the link that holds it (0: none), and the element.
        self.buffer: list[tuple[str, int, _Node]] = []
        self.links = 0
        self.tags = 0
        self.lines: list[_Line] = []

    def _flush(self) -> None:
        """The block's text as a line; what weighs otherwise than the block's first text is a line of its own."""
        if not self.buffer:
            return
        parts: dict[float, list[tuple[str, int, _Node]]] = {}
        for p in self.buffer:
            parts.setdefault(p[2].weight, []).append(p)
        for some in parts.values():
            text = " ".join("".join([p[0] for p in some]).split())
            if text:
                own = {p[1] for p in some if _LETTER.search(p[0])}
                self.lines.append(_Line(text, self.tags, self._block(some[0][2]), 0 if 0 in own else len(own)))
        self.buffer = []

    def _pop(self, to: int) -> None:
        for node in self.open[to:]:
            self.count[node.tag] -= 1
        del self.open[to:]

    def _close(self, wanted: set[str], barrier: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in wanted:
                self._pop(i)
                return
            if tag in barrier:
                return

    def _is_outside(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if self.open[-1].outside or tag in OUTSIDE:
            return True
        within = self.count.get("article", 0) or self.count.get("main", 0)
        if tag == "header" and not within:
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search((attrs.get("style") or "").lower()):
            return True
        return False

    def _name(self, node: _Node, words: set[str]) -> None:
        """What the words of an element's class, id and role weigh."""
        tag, parent = node.tag, node.parent
        if tag in ("html", "body", "main"):
            return
        if parent.content and node.talk is not None and (words & COMMENT_WORDS or tag in ("form", "textarea", "button")):
            node.talk[0] += 1 if words & COMMENT_WORDS else REPEATS
        if words & COMMENT_WORDS:
            if not parent.content or words & (COMMENT_WORDS - TALK_WORDS):
                node.weight = LAYOUT_WEIGHT
            elif node.talk is None:
                node.talk, node.topic = [0], node.topic or node
        elif not words & ARTICLE_WORDS and tag != "article":
            within = self.count.get("article", 0) or self.count.get("main", 0)
            if words & LAYOUT_WORDS and not (tag == "header" or (within and words & LAYOUT_WORDS == {"header"})):
                node.weight = LAYOUT_WEIGHT
            elif words & TOPIC_WORDS:
                if parent.content:
                    node.topic = node.topic or node
                else:
                    node.weight = min(node.weight, TOPIC_WEIGHT)

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self._tag()
        if tag == "br":
            self.buffer.append((" ", 0, self.open[-1]))
            return
        if tag in BLOCK:
            self._flush()
            if self.count.get("p", 0):
                self._close({"p"}, {"table", "button", "object", "td", "th", "caption", "article", "section", "div", "li", "blockquote"})
            if tag in CLOSES and self.count:
                self._close(*CLOSES[tag])
            if tag == "body" and self.count.get("head", 0):  # an unclosed head
                self._close({"head"}, set())
        if tag in VOID:
            return
        attrs = dict(attributes)
        named = tag in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articleBody"
        self.links += tag == "a"
        words = set(_WORDS.findall(" ".join(attrs.get(k) or "" for k in ("class", "id", "role")).lower()))
        node = _Node(tag, self.open[-1], self._is_outside(tag, attrs), named, bool(words & CONTENT_WORDS))
        self._name(node, words)
        self.open.append(node)
        self.nodes.append(node)
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)  # as browsers do: the slash closes nothing but void elements

    def handle_endtag(self, tag: str) -> None:
        self._tag()
        if tag in BLOCK:
            self._flush()
        if not self.count.get(tag, 0):
            return
        for i in range(len(self.open) - 1, 0, -1):
            here = self.open[i].tag
            if here == tag:
                self._pop(i)
                return
            if tag not in BLOCK and here in BLOCK:  # a stray end of an inline element
                return

    def _tag(self) -> None:
        self.tags += 1

    @staticmethod
    def _block(node: _Node) -> _Node:
        while node.tag not in BLOCK and node.parent is not None:
            node = node.parent
        return node

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if not top.outside:
            self.buffer.append((data, self.links if self.count.get("a", 0) else 0, top))

    def finish(self) -> list[_Line]:
        self.close()
        self._flush()
        return self.lines


def counted(lines: list[_Line]) -> list[_Line]:
    """The lines with the tags since the one before."""
    at = 0
    for x in lines:
        x.tags, at = x.at - at, x.at
    return lines


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, the kernel renormalised at the borders."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach : reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def content_lines(lines: list[_Line], sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Lines whose smoothed text-to-tag ratio reaches the threshold, a share of the spread as in
    the ratio's own distribution; at least the densest line. Then those of them that reach it by themselves."""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines], float)
    smooth = smoothed(ratio, sigma)
    least = min(float(smooth.max()), 0.5 * float(smooth.std()) or float(smooth.max())) * (1 - 1e-9)
    good = smooth >= least
    dense = good & (ratio >= least)
    return good, dense if dense.any() else good


def weighed(lines: list[_Line], sigma: float) -> tuple[list[_Line], list[_Line]]:
    """The lines that names leave as they are, and those that need a higher ratio; none of the latter where by density all content is among them."""
    rest, aside = [x for x in lines if not x.node.set_aside()], [x for x in lines if x.node.set_aside()]
    if not aside:
        return counted(rest), []
    dense = content_lines(counted(lines), sigma)[1]
    if not rest or all(lines[k].node.set_aside() for k in dense.nonzero()[0].tolist()):
        return lines, []
    return counted(rest), aside


def menus(lines: list[_Line], dense: np.ndarray) -> np.ndarray:
    """Lines of links only: several in one line, or such lines in a row. Not those in an article, nor those between dense lines of their list's element."""
    some = np.array([x.links > 0 for x in lines])
    near = np.zeros(len(some), bool)
    near[1:] |= some[:-1]
    near[:-1] |= some[1:]
    menu = some & (near | np.array([x.links > 1 for x in lines])) & np.array([not x.node.article for x in lines])
    if menu.any():
        holders = [_holder(x.node) for x in lines]
        spans: dict[_Node, list[int]] = {}
        for k in (dense & ~menu).nonzero()[0].tolist():
            spans.setdefault(holders[k], [k, k])[1] = k
        for k in menu.nonzero()[0].tolist():
            first, last = spans.get(holders[k], (k, k))
            menu[k] = not (first < k < last and holders[k].tag not in PAGE)
    return menu


def _holder(node: _Node) -> _Node:
    """The element that holds a line's block or list."""
    while node.parent is not None and (node.tag in SINGLE or node.tag in ("ul", "ol", "dl")):
        node = node.parent
    return node


def regions(root: _Node) -> list[_Node]:
    """The elements that together hold all dense lines.

    It is the innermost element that holds all; if that lies in a named element, the whole of the nearest such one. The
    page, and an element of which only a part is named, are taken apart, branch by branch.
    """
    out, left = [], [root]
    while left:
        node = whole = left.pop()
        while not node.dense and len(node.kids) == 1:
            node = node.kids[0]
            whole = whole if node.tag in SINGLE else node
        named: _Node | None = node
        while named is not None and not named.named:
            named = named.parent
        if named is not None:
            out.append(named)
        elif not node.names and (node.dense or whole.tag not in PAGE):
            out.append(whole)
        else:
            left += node.kids
    return out


def main_text(html: str, sigma: float = 1.0) -> str:
    """The article's blocks, joined by empty lines: all lines of the regions, and content lines elsewhere."""
    parser = Lines()
    if html.rfind("<!--") > html.rfind("-->"):
        html += "-->"  # an open comment ends with the page
    tail = html.rfind(">") + 1
    if opened := _OPENED.search(html, tail):
        html = html[: opened.start()]  # markup that never closes is no text
    parser.feed(html)
    every = parser.finish()
    if not every:
        return ""
    lines, aside = weighed(every, sigma)
    good, dense = content_lines(lines, sigma)
    menu = menus(lines, dense)
    if menu.all():
        menu[:] = False
    if (dense & ~menu).any():
        dense &= ~menu
    topics = set()
    for k in dense.nonzero()[0].tolist():
        node = lines[k].node
        topics.add(node.topic)
        while node.tag in SINGLE and node.parent is not None and not node.named:
            node = node.parent
        node.dense = True
    for node in reversed(parser.nodes[1:]):
        if node.dense or node.kids:
            node.parent.kids.append(node)
            node.parent.names |= node.names or node.named
    for node in regions(parser.root):
        node.inside = True
    for node in parser.nodes[1:]:
        node.inside |= node.parent.inside
    kept = {
        id(x)
        for x, fine, link in zip(lines, good.tolist(), menu.tolist(), strict=True)
        if (fine or x.node.inside) and not link and (x.node.topic is None or x.node.topic in topics)
    }
    if aside:
        least = min(len(x.text) / max(1, x.tags) for x, d in zip(lines, dense.tolist(), strict=True) if d)
        for x in counted(every):
            weight = x.node.weight if x.node.weight < 1 else LAYOUT_WEIGHT
            if x.node.set_aside() and len(x.text) / max(1, x.tags) * weight >= least:
                kept.add(id(x))
    return "\n\n".join(x.text for x in every if id(x) in kept)


def extract_main_text(df: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """Append the main text of each whole page; one pass, no shuffle."""
    fields = T.StructType([T.StructField(out, T.StringType())])
    return append_columns(df, fields, lambda batch: [pa.array([main_text(h) for h in texts(batch, html_col)], pa.string())])
