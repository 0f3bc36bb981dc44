"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

A page streams through the standard library's HTML parser once, in time linear in its
length and nesting.  Block tags cut its text into lines; each line knows how many tags
and link characters it has and its innermost container.  Lines of page furniture, told
by element, role or the words of class and id, are marked and go.

The ratio of text to tags of every other line is smoothed with a Gaussian, and lines
over the threshold form the content cluster.  The cluster selects the *region*: the
innermost container of all content lines, without its outer parts that hold none.
Where nearly all content lies in articles, these are the region.  Names that only
partly tell furniture are a tie that the cluster breaks: such an element goes if it
holds no content line.  Every other line of the region is kept whole, short ones too;
without articles, lines that are mostly links go where they follow each other or hold
several links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Reach and width of the smoothing in lines; threshold in standard deviations of the smoothed ratios.
RADIUS, SIGMA, LEVEL = 2, 1.0, 0.5
#: Share of the content that articles must hold to be the region, and of link characters that make a menu.
SHARE, LINKS = 0.8, 0.5

_words = lambda s: frozenset(s.split())
INLINE = _words("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source math mfrac mi mn mo mover mroot mrow msqrt msub msubsup msup mtext munder semantics")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
SILENT = _words("script style head title noscript template iframe svg object audio video canvas map select option optgroup datalist textarea button")
FURNITURE = _words("nav aside footer form menu dialog search fieldset")
CONTAINERS = _words("article main section div td body blockquote center")
ROLES = _words("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note status")
CLOSED_BY = {"p": _words("p div ul ol li table section article aside nav header footer h1 h2 h3 h4 h5 h6 blockquote form pre main dl figure hr address"), "li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr tbody tfoot"), "td": _words("td th tr"), "th": _words("td th tr"), "option": _words("option optgroup")}
#: Words of class or id that mark furniture, anywhere or only outside articles.
MARKS = _words(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr "
    "notice notices alert alerts popup modal overlay nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager masthead footer sidebar sidebars aside rail "
    "widget widgets related recommended recommendations social share sharing comment comments commentlist disqus reply replies respond discussion newsletter subscribe subscription "
    "signup login outbrain taboola skip paywall toolbar copyright"
)
LOOSE = _words("header side form search tags legal disclaimer foot top bottom links follow secondary meta language")
GOOD = _words("article content main post entry story text body page")
LAYOUT = _words("with has no without open")
#: Words that tell nothing of what an element holds; beside them a mark is certain.
NEUTRAL = _words(
    "area areas article articles bar bars block blocks body bottom box boxes btn button buttons card cards cell col column columns container content count desktop entry fixed float "
    "full global group heading holder horizontal icon icons inline inner item items js label left link links list lists main media message mobile module outer page panel post posts "
    "primary right row secondary section sections site slot small static sticky story stories text thread title top unit vertical view wrap wrapper zone"
)
PLAIN = _words("p li h1 h2 h3 h4 h5 h6 dt dd figcaption caption pre code td th tr")
_BARRIERS = _words("div article main section body nav table ul ol aside")
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_FURNITURE, _SUSPECT = 2, 1


class _Lines(HTMLParser):
    """Collects lines as (text, tags, link characters, container, suspect element, links, whether a top heading)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: dict[tuple, int] = {}

    def begin(self) -> None:
        self.reset()
        self.lines: list[tuple] = []
        self.pieces: list[str] = []
        self.tags = self.linked = self.silent = self.articles = self.links = self.anchors = 0
        self.stack: list[tuple] = []  # (tag, silent, mark, article, container, suspect before)
        self.at: dict[str, list[int]] = {}  # where in the stack a tag is open
        self.blocks: list[int] = []  # where blocks and marked elements are
        self.marked: list[int] = []
        self.container = self.suspect = -1
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.suspects = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # as browsers do; the base class knows a few keywords only

    def cut(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                if not self.marked:
                    self.lines.append((text, self.tags, self.linked, self.container, self.suspect, self.anchors, bool(self.at.get("h1"))))
                self.tags = 0
            self.pieces, self.linked, self.anchors = [], 0, 0

    def _mark(self, tag: str, attrs: list) -> int:
        key = (tag, self.articles > 0, *attrs)
        known = self.seen.get(key)
        if known is None:
            if len(self.seen) > 5000:
                self.seen.clear()
            known = self.seen[key] = self._judge(tag, attrs)
        return known

    def _judge(self, tag: str, attrs: list) -> int:
        if tag in FURNITURE or tag == "header" and not self.articles:
            return _FURNITURE
        a = {k: v or "" for k, v in attrs}
        if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
            return _FURNITURE
        if tag in ("body", "html"):
            return 0
        tokens = [{w.lower() for w in _SPLIT.split(x) if w} for x in f"{a.get('class', '')} {a.get('id', '')}".split()]
        tokens = [t for t in tokens if not t & LAYOUT]
        words = set().union(*tokens)
        if tag in ("article", "main"):
            return _FURNITURE if words & MARKS and not words & GOOD else 0
        loose = frozenset() if self.articles or words & GOOD else LOOSE
        found = 0
        for t in tokens:
            if t & (MARKS | loose):
                certain = all(w in MARKS or w in loose or w in NEUTRAL or len(w) == 1 or w.isdigit() for w in t)
                found = max(found, _FURNITURE if certain else _SUSPECT if tag not in PLAIN and t & MARKS else 0)
        return found

    def _push(self, tag: str, silent: int, mark: int, article: int, container: int) -> None:
        at = len(self.stack)
        self.stack.append((tag, silent, mark == _FURNITURE, article, container, self.suspect))
        self.at.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        if mark == _FURNITURE:
            self.marked.append(at)
        elif mark:
            self.suspects += 1
            self.suspect = self.suspects

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in INLINE:
            if tag == "a":
                self._close("a")
                self.links += 1
                self.anchors += 1
                self._push(tag, 0, 0, 0, -1)
            elif tag not in VOID:
                mark = self._mark(tag, attrs) if attrs else 0
                if mark:
                    self.cut()
                self._push(tag, 0, mark, 0, -1)
            return
        self.cut()
        if tag in VOID:
            return
        while self.blocks and tag in CLOSED_BY.get(self.stack[self.blocks[-1]][0], ()):
            self._pop(self.blocks[-1])
        if tag in ("article", "main") and self.marked and not self.articles:  # furniture that was never closed
            for k in self.marked:
                if self.stack[k][0] not in ("dialog", "form"):
                    self._pop(k)
                    break
        silent = int(tag in SILENT)
        mark = 0 if silent else self._mark(tag, attrs)
        article = int(tag in ("article", "main") or any(k == "role" and v == "main" or k == "itemprop" and v == "articleBody" for k, v in attrs))
        number = -1
        if tag in CONTAINERS or article:
            number = len(self.kinds)
            self.kinds.append("article" if article else tag)
            self.parents.append(self.container)
            self.container = number
        self.silent += silent
        self.articles += article
        self._push(tag, silent, mark, article, number)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.cut()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.cut()
        self._close(tag)

    def _close(self, tag: str) -> None:
        """Close the innermost such element, unless an element that it can't reach over is open in it."""
        at = self.at.get(tag)
        if not at:
            return
        k = at[-1]
        if tag in INLINE:
            if self.blocks and self.blocks[-1] > k:
                return
        elif tag in ("p", "li", "td", "th", "tr", "dd", "dt"):
            over = ("div", "section", "ul", "ol") if tag in ("td", "th", "tr") else ()
            if any(self.at[b][-1] > k for b in _BARRIERS if b not in over and self.at.get(b)):
                return
        self._pop(k)

    def _pop(self, k: int) -> None:
        for tag, silent, mark, article, number, suspect in reversed(self.stack[k:]):
            if mark or suspect != self.suspect:
                self.cut()
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            if mark:
                self.marked.pop()
            self.silent -= silent
            self.articles -= article
            self.links -= tag == "a"
            self.suspect = suspect
            if number >= 0:
                self.container = self.parents[number]
        del self.stack[k:]

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data)


def smooth(ratio: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; beyond its ends the sequence counts as zero."""
    at = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(at**2) / (2 * SIGMA**2))
    return np.convolve(ratio, kernel / kernel.sum(), mode="full")[RADIUS:-RADIUS]


def main_text(html: str | None, parser: _Lines | None = None) -> str:
    """The main text of one page; empty for a null, blank or textless page.  Broken markup is read as browsers read it."""
    if not html:
        return ""
    p = parser or _Lines()
    p.begin()
    p.feed(html)
    if _OPEN.match(p.rawdata):
        p.rawdata = ""  # a tag or comment that the page ends in
    p.close()
    p.cut()
    lines = p.lines
    if not lines:
        return ""
    size = np.fromiter((len(x[0]) for x in lines), np.float64, len(lines))
    home = np.fromiter((x[3] for x in lines), np.int64, len(lines))
    menu = np.fromiter((x[2] > LINKS * len(x[0]) for x in lines), bool, len(lines))
    ratio = np.where(menu, 0.0, size / np.fromiter((max(1, x[1]) for x in lines), np.float64, len(lines)))
    even = smooth(ratio)
    content = (even >= LEVEL * even.std()) & ~menu
    if not content.any():
        content = ~menu if not menu.all() else ~content
    suspect = np.fromiter((x[4] for x in lines), np.int64, len(lines))
    sure = np.isin(suspect, suspect[content])
    sure[suspect < 0] = True
    region, articles = _region(p, home, np.where(content, size, 0.0))
    keep = sure & region[home]
    if not articles:
        # a line that is one link may be a paragraph; links in a row are a menu
        beside = np.concatenate([[False], menu[:-1]]) | np.concatenate([menu[1:], [False]])
        keep &= ~(menu & (beside | (np.fromiter((x[5] for x in lines), np.int64, len(lines)) > 1)))
        keep &= _inside(p, region, home, content) | np.fromiter((x[6] for x in lines), bool, len(lines))
    return " ".join(lines[k][0] for k in np.flatnonzero(keep).tolist())


def _region(p: _Lines, home: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, bool]:
    """For each container, and last for lines in none, whether it lies in the region; whether that is articles.

    ``weight`` is the content of each line, ``home`` its container.
    """
    n, parents = len(p.kinds), p.parents
    held = np.bincount(home + 1, weights=weight, minlength=n + 1)[1:].tolist()
    for c in range(n - 1, -1, -1):  # parents come before their children
        if parents[c] >= 0:
            held[parents[c]] += held[c]
    total = float(weight.sum())
    inner = [0.0] * n  # content in the articles next below
    chosen = [False] * n
    for c in range(n - 1, -1, -1):
        article = p.kinds[c] == "article" and held[c] > 0
        if parents[c] >= 0:
            inner[parents[c]] += held[c] if article else inner[c]
        chosen[c] = article and inner[c] < held[c]
    region, under = np.zeros(n + 1, bool), 0.0
    for c in range(n):
        up = parents[c]
        region[c] = chosen[c] or up >= 0 and region[up]
        if chosen[c] and not (up >= 0 and region[up]):
            under += held[c]
    if under >= SHARE * total > 0:
        return region, True
    depth, best, deepest = [0] * n, -1, -1
    for c in range(n):
        depth[c] = depth[parents[c]] + 1 if parents[c] >= 0 else 0
        if held[c] == total > 0 and depth[c] > deepest:
            best, deepest = c, depth[c]
    if best < 0:
        return np.ones(n + 1, bool), False
    region = np.zeros(n + 1, bool)
    for c in range(best, n):
        region[c] = c == best or parents[c] >= 0 and region[parents[c]]
    return region, False


def _inside(p: _Lines, region: np.ndarray, home: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Lines that aren't in an outer part of the region without content, before all of it or after all of it."""
    part = np.full(len(p.kinds) + 1, -1)  # the part of the region that a container lies in
    for c in range(len(p.kinds)):
        up = p.parents[c]
        if region[c] and up >= 0 and region[up]:
            part[c] = part[up] if part[up] >= 0 else c
    at = np.flatnonzero(content)
    between = np.zeros(len(home), bool)
    between[at[0] : at[-1] + 1] = True
    mine = part[home]
    return between | (mine < 0) | np.isin(mine, mine[content])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of ``html_col``.

    A null page has an empty text.  Columns named ``text`` or ``n_chars`` are replaced;
    rows are neither joined nor dropped, whatever their ids.
    """
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parser = _Lines()
        for html in batches:
            yield pd.Series([main_text(h, parser) for h in html], dtype="object")

    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    return pages.select(*keep, texts(html_col).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
