"""Main text of web pages by text-to-tag ratios (Weninger, Hsu, Han 2010).

The standard library's parser streams a page as events. These become lines, one per block
element, each with its text, its number of tags and the share of its text in links. The
ratio of text to tags per line is smoothed with a Gaussian and cut at its standard
deviation; runs of lines above the cut are the content regions. All ``article`` and ``main``
elements of a page, side by side or nested, are its article. Where they do not hold half of the
regions' text, it is the regions, what lies between them, and the innermost container with all
of them. All its lines are returned but lines of links outside the regions and those of menus, headers, footers, sidebars,
notices, adverts, forms, comments and the like, told by element, role and class names.

Inside an article names are weak evidence: an id is often made from a title, and a part on social impact or related work is
text like any other. There a heading is never judged by its name, and other blocks are dropped by name only
if all of the name says so and it is one of CERTAIN_NAMES. Any other listed word makes the block a suspect, which goes if
its text is mostly links or if no line of it lies in a content region.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGMA, RADIUS = 1.0, 2
#: Text-to-tag ratio of a full paragraph; a longer line counts as one, as else it lifts the cut above all others.
PARAGRAPH = 100.0
#: Article elements that hold less of the content regions' text do not mark the article alone.
COVER = 0.5
#: Elements that can hold a whole article; a paragraph, heading, list or cell is a part of one.
CONTAINERS = set("body center div fieldset html section".split())

BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot"
    " th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never belong to an article's text.
DROPPED = set(
    "aside audio button canvas dialog footer form head header iframe input map menu nav noscript object option script"
    " select style svg template textarea title video".split())
DROPPED_ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words in class and id that mark what surrounds an article.
DROPPED_NAMES = set(
    "ad ads advert adverts advertisement advertising advertorial adsense banner breadcrumb breadcrumbs comment"
    " comments commentary consent cookie cookies copyright discussion disqus disclaimer footer gdpr header login"
    " masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall"
    " popup privacy promo promoted promotion recommended related replies reply respond responses share sharing sidebar"
    " sidebars signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets"
    .split())
#: Those that mark it inside an article too, if nothing else in the name speaks against it; and words that say nothing.
CERTAIN_NAMES = set(
    "ad ads advert adverts advertisement advertising advertorial adsense breadcrumb breadcrumbs comment comments cookie cookies"
    " disqus gdpr masthead modal nav navbar newsletter outbrain pager pagination paywall popup sidebar sidebars signup"
    " taboola toolbar topbar widget widgets".split())
PLAIN_NAMES = set("area banner bar block body box button container content form frame inner inline item items left link links list"
                  " main outer panel right row section slot top bottom wrap wrapper".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ARTICLE_NAMES = set("article content main body post entry story text page layout".split())
FRAME_NAMES = set("wrap wrapper wrapped container layout page has with no grid row col".split())
#: Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCK - {"head", "title", "html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
#: An element that ends an open one of the same kind, and the elements that shield the open one.
SIBLINGS = {
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "option": ("option", {"select"}),
    "tr": ("tr td th", {"table"}), "td": ("td th", {"table", "tr"}), "th": ("td th", {"table", "tr"}),
}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Line:
    node: int
    dropped: bool
    tags: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class PageLines(HTMLParser):
    """Turns a page's events into lines and a tree of its elements (parent of each, whether it is dropped, its kind)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parent, self.dropped, self.kind, self.holds = [-1], [False], [""], [True]
        #: The outermost suspect that a node lies in, itself included; 0 if none.
        self.suspect = [0]
        self.open: list[tuple[str, int]] = []
        self.counts: dict[str, int] = {}
        #: The open line of kept and of dropped text; only a block's edge ends them.
        self.line: dict[bool, Line] = {}
        self.tags = 0

    # -- events
    def handle_starttag(self, tag, attrs):
        self.tags += 1
        self._imply_ends(tag)
        if tag in BLOCK:
            self.line = {}
        if tag == "br":
            self._add(" ")
        if tag in VOID:
            return
        values = {k: v or "" for k, v in attrs}
        if tag in ("article", "main") and not self._is_dropped(tag, values):
            self._leave_frames()
        above = self._node()
        dropped = self.dropped[above]
        if tag in HEADINGS and self.kind[above] == "own-header":
            dropped = False  # an article's title stands in its own header
        elif not dropped:
            dropped = self._is_dropped(tag, values)
        kind = ""
        if tag == "header" and dropped and not self.dropped[above] and self._in_article():
            kind = "own-header"
        elif self.kind[above] == "own-header" and dropped:
            kind = "own-header"
        elif not dropped and (tag in ("article", "main") or values.get("role") in ("article", "main")):
            kind = "article"
        self.suspect.append(self.suspect[above] or (len(self.parent) if self._is_suspect(tag, values) else 0))
        self.parent.append(above)
        self.dropped.append(dropped)
        self.kind.append(kind)
        self.holds.append(tag in CONTAINERS)
        self.open.append((tag, len(self.parent) - 1))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "li", "td", "section", "article"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.line = {}
        if self.counts.get(tag, 0):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        self._add(data)

    # -- state
    def _node(self) -> int:
        return self.open[-1][1] if self.open else 0

    def _in_article(self) -> bool:
        return bool(self.counts.get("article", 0) or self.counts.get("main", 0))

    def _pop(self) -> str:
        tag, _ = self.open.pop()
        self.counts[tag] -= 1
        return tag

    def _imply_ends(self, tag):
        if tag in ENDS_PARAGRAPH and self.counts.get("p", 0):
            self._close({"p"}, {"button", "table", "td", "article", "section", "div", "li", "blockquote"})
        if tag in SIBLINGS:
            names, shields = SIBLINGS[tag]
            self._close(set(names.split()), shields)

    def _close(self, names, shields):
        """Close the outermost open element of ``names`` above the nearest of ``shields``, with all inside it."""
        at = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                at = i
            elif self.open[i][0] in shields:
                break
        while at is not None and len(self.open) > at:
            self._pop()

    def _leave_frames(self):
        """An article opens: a menu or header that was never closed ends before it."""
        for i, (tag, node) in enumerate(self.open):
            if tag in ("nav", "header", "script", "style") and self.dropped[node]:
                while len(self.open) > i:
                    self._pop()
                return

    def _is_dropped(self, tag, values) -> bool:
        if tag in DROPPED or tag in ("html", "body"):
            return tag in DROPPED
        if "hidden" in values or values.get("aria-hidden") == "true" or values.get("role", "").lower() in DROPPED_ROLES:
            return True
        if "style" in values and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values["style"].lower()):
            return True
        return any(self._says_dropped(tag, words) for words in self._named(values))

    @staticmethod
    def _named(values) -> list[set[str]]:
        """The words of every class and of the id that hold a listed one and do not name an article's frame."""
        found = []
        for name in f"{values.get('class', '')} {values.get('id', '')}".split():
            words = {w.lower() for w in _NAME.findall(name)}
            if words & DROPPED_NAMES and not (words & FRAME_NAMES and words & ARTICLE_NAMES):
                found.append(words)
        return found

    def _says_dropped(self, tag, words) -> bool:
        if tag in ("article", "main"):
            return bool(words & {"comment", "comments", "reply", "related", "promo", "ad"})
        if self._in_article():
            return tag not in HEADINGS and bool(words & CERTAIN_NAMES) and words <= DROPPED_NAMES | PLAIN_NAMES
        return True

    def _is_suspect(self, tag, values) -> bool:
        return self._in_article() and tag not in HEADINGS and tag not in ("article", "main") and bool(self._named(values))

    def _add(self, data):
        node = self._node()
        line = self.line.get(self.dropped[node])
        if line is None:
            if not data.strip():
                return
            # a line belongs to the nearest block element
            at = next((n for t, n in reversed(self.open) if t in BLOCK), 0)
            line = self.line[self.dropped[node]] = Line(at, self.dropped[node], 0)
            self.lines.append(line)
        line.tags += self.tags
        self.tags = 0
        line.pieces.append(data)
        if self.counts.get("a", 0):
            line.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing, with the kernel cut to what lies on the page."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[radius:radius + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[radius:radius + len(ratios)]


def content_lines(lines: list[Line], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """True for lines in content regions (smoothed text-to-tag ratio above its standard deviation), and for their cores.

    The core of a region are the lines above the cut by themselves, not only by their neighbours.
    """
    ratio = np.array([
        0.0 if line.dropped else len(text) * (1 - min(1.0, line.linked / max(1, len(text)))) / max(1, line.tags)
        for line, text in zip(lines, texts)])
    ratio = np.minimum(ratio, PARAGRAPH)
    smooth = smoothed(ratio)
    above = (smooth > smooth.std()) & (ratio > 0)
    if not above.any():
        above = ratio >= max(ratio.max(), 1e-9)
    core = above & (ratio > smooth.std())
    return above, core if core.any() else above


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line; empty for NULL, empty pages and pages without an article."""
    page = PageLines()
    page.feed(html or "")
    page.close()
    kept = [(line, text) for line in page.lines if (text := line.text)]
    if not any(not line.dropped for line, _ in kept):
        return ""
    lines, texts = [x for x, _ in kept], [x for _, x in kept]
    content, core = content_lines(lines, texts)
    articles = [n for n, kind in enumerate(page.kind) if kind == "article"]
    nearest = _nearest(page.parent, articles)
    complete = _complete(nearest, page.parent, articles, lines, content)
    scope = np.array([nearest[line.node] > 0 for line in lines])
    size = np.array([len(text) for text in texts])
    usable = np.array([not line.dropped for line in lines])
    if not (scope & usable).any() or size[content & scope].sum() < COVER * size[content].sum():
        # the regions, what stands between them, and the element around their cores
        where = np.flatnonzero(content)
        if len(where):
            scope[where[0]:where[-1] + 1] = True
        own = _inside(page.parent, _container(page, lines, core))
        scope |= np.array([own[line.node] for line in lines])
    cleared = _cleared(page, lines, texts, content)
    return "\n\n".join(
        t for line, t, good, within in zip(lines, texts, content, scope)
        if page.suspect[line.node] in cleared
        # outside the regions and a complete article, a line of links is a menu
        and within and not line.dropped and (good or nearest[line.node] in complete or line.linked <= 0.5 * len(t)))


def _cleared(page: PageLines, lines: list[Line], texts: list[str], content: np.ndarray) -> set[int]:
    """0 and the suspects that are text: not mostly links, and some line of theirs in a content region."""
    size, linked, inside = {}, {}, set()
    for line, text, good in zip(lines, texts, content):
        at = page.suspect[line.node]
        size[at], linked[at] = size.get(at, 0) + len(text), linked.get(at, 0) + line.linked
        if good:
            inside.add(at)
    return {0} | {at for at in inside if linked[at] <= 0.5 * size[at]}


def _container(page: PageLines, lines: list[Line], core: np.ndarray) -> int:
    """The innermost container that holds all core lines; the whole page if there are none."""
    held = np.zeros(len(page.parent), int)
    for line, good in zip(lines, core):
        held[line.node] += good
    for node in range(len(page.parent) - 1, 0, -1):
        held[page.parent[node]] += held[node]
    return max(n for n in range(len(held)) if page.holds[n] and held[n] == held[0]) if held[0] else 0


def _nearest(parent: list[int], articles: list[int]) -> list[int]:
    """The innermost of ``articles`` that each node lies in, itself included; 0 outside."""
    nearest, among = [0] * len(parent), set(articles)
    for node in range(1, len(parent)):
        nearest[node] = node if node in among else nearest[parent[node]]
    return nearest


def _complete(nearest, parent, articles, lines, content) -> set[int]:
    """Articles of which every line counts: those that hold region text and no further article (all, if none has any)."""
    with_text = {nearest[line.node] for line, good in zip(lines, content) if good} - {0}
    return with_text - {nearest[parent[n]] for n in articles} if with_text else set(articles)


def _inside(parent: list[int], top: int) -> np.ndarray:
    inside = np.zeros(len(parent), bool)
    inside[top] = True
    for node in range(top + 1, len(parent)):
        inside[node] = inside[parent[node]]
    return inside


def extract(html: Column) -> Column:
    """``main_text`` of each page; never NULL."""
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype="object")
    return of(html)


def extract_pages(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``name``, which replaces a column of that name; repeated rows all stay."""
    return pages.withColumn(name, extract(F.col(html)))
