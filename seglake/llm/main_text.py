"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped so that every block of text is a line and every container border a gap of empty lines. Text lengths are
summed over sliding windows of lines. A window that rises over a threshold is a surge, a window without text is a dive. The
text from the first region with a surge, heading or paragraph to the last one is kept whole. Structure is evidence for the
regions: what stands in containers that never hold the article (menus, headers, footers, side bars, notices, adverts, forms,
comments) is stripped with the markup, and where ``article`` or ``main`` elements hold text, the first and the last region are
sought among the regions in them. An article much shorter than the longest one is a teaser and no evidence."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType

from .common import append_columns

#: Lines in a window, and the characters in a window that make a surge.
WINDOW, SURGE = 3, 60
#: A region with a larger share of its characters inside links is a list of links; the text does not begin or end there.
LINKS = 0.6
#: Elements whose content is never article text, taken out whole up to their closing tag or the end of the page.
RAW = "script style noscript template textarea iframe svg math object select canvas video audio title".split()
#: Quotes count after an equals sign only, and only if they are closed, so every tag ends and the scan is linear.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b{ATTRIBUTES}(?<=/)>|<(?P<raw>{'|'.join(RAW)})\b{ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>{ATTRIBUTES})(?:>|(?P<unfinished>\Z))|<[!?][^>]*(?:>|\Z)",
    re.S | re.I)
CLASSES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "embed", "area", "base", "col", "param", "track"}
SHED = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "datalist"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "table", "ul", "ol", "dl", "form", "fieldset", "center"}
#: Lists and tables part lines, but leave no gap.
DENSE = {"ul", "ol", "dl", "table"}
LINES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "address",
         "figure", "figcaption", "details", "summary", "hr", "br", "legend", "hgroup", "option", "head"} | CONTAINERS
LISTS = {"ul", "ol", "menu"}
#: Elements that may be shed and stand inside lines.
INLINE = {"span", "a", "button"}
#: Elements of which one line makes a place of text.
BODY = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
#: Names in class, id or role that mark a container without article text.
SHED_NAMES = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "contentinfo", "sidebar", "aside", "complementary",
    "widget", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "comment", "comments", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "search", "login", "form",
}
#: Words that may follow such a name (``comments-area``, ``sidebar-left``), and words that turn a name into a remark on a layout.
FOLLOW = {"area", "bar", "block", "body", "bottom", "box", "buttons", "container", "content", "icons", "inner", "items", "left", "links", "list", "outer", "panel", "posts",
          "articles", "right", "row", "section", "slot", "thread", "top", "unit", "widget", "wrap", "wrapper"}
REMARKS = {"with", "has", "no", "without", "is", "not"}
#: An article element with a smaller share of the longest one's markup is a teaser.
TEASER = 0.25
#: Elements that are never taken for such containers by their class.
WHOLE = {"html", "body", "main"}


def named_off(attributes: str) -> bool:
    """Class, id or role names a container without article text: a name of SHED_NAMES, alone or at the end of a longer name."""
    for token in " ".join("".join(m) for m in CLASSES.findall(attributes)).split():
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
        while len(words) > 1 and words[-1] in FOLLOW:
            words.pop()
        if words and words[-1] in SHED_NAMES and words[0] not in REMARKS:
            return True
    return False


class Page:
    """The tags of one page, with the index of each one's closing tag, and the articles among them."""

    def __init__(self, page: str):
        self.tags = list(MARKUP.finditer(page))
        self.names = ["" if m["unfinished"] is not None else (m["tag"] or "").lower() for m in self.tags]
        self.closed = [bool(m["end"]) for m in self.tags]
        self.closing: dict[int, int] = {}
        waiting: dict[str, list[int]] = {}
        for i, name in enumerate(self.names):
            if name and name not in VOID:
                if not self.closed[i]:
                    waiting.setdefault(name, []).append(i)
                elif waiting.get(name):
                    self.closing[waiting[name].pop()] = i
        size = {i: (self.tags[self.closing[i]].start() if i in self.closing else len(page)) - self.tags[i].end() for i, name in enumerate(self.names)
                if name == "article" and not self.closed[i] and not named_off(self.tags[i]["attributes"])}
        largest = max(size.values(), default=0)
        main = [i for i, name in enumerate(self.names) if name == "main" and not self.closed[i]]
        self.articles = {i for i, n in size.items() if n >= TEASER * largest} | set(main)
        self.evidence = sorted(self.articles | {i for i, name in enumerate(self.names) if name == "h1" and not self.closed[i]})

    def wraps(self, i: int) -> bool:
        """Element ``i`` holds a heading of the page, or an article."""
        at = bisect_right(self.evidence, i)
        return i in self.closing and at < len(self.evidence) and self.evidence[at] < self.closing[i]

    def sheds(self, i: int, in_article: bool) -> bool:
        tag, attributes = self.names[i], self.tags[i]["attributes"]
        if tag in SHED and tag != "form" or tag == "header" and not in_article:
            return True
        if tag not in CONTAINERS and tag not in ("p", "span", "li", "a") or tag in WHOLE:
            return False
        if HIDDEN.search(attributes):
            return True
        return (tag == "form" or named_off(attributes)) and i not in self.articles and not self.wraps(i)

    def end(self, i: int, within: Counter[str]) -> tuple[int, bool]:
        """Index of the tag that ends element ``i``, and whether that is its own closing tag.

        A p ends at the next block, an li at the next li or the end of its list, head at body. Whatever is not closed ends at an
        article that follows, or where a container around it (``within``) ends, or at the end of the page; an inline element
        already at the first block."""
        tag, own, lists, article = self.names[i], self.closing.get(i), 0, None
        inner: Counter[str] = Counter()
        for j in range(i + 1, len(self.tags)):
            other, closed = self.names[j], self.closed[j]
            if not other:
                continue
            if tag == "p" and other in LINES and other != "br":
                return j, closed and other == "p"
            if tag == "li" and not lists and other == "li":
                return j, closed
            if tag == "head" and other == "body":
                return j, False
            if tag == "li" and other in LISTS:
                lists += -1 if closed else 1
                if lists < 0:
                    return j, False
            if j == own and tag != "li":
                return j, True
            if own is None and tag in INLINE and other in LINES and other != "br":
                return j, False
            if other in CONTAINERS:
                if article is None and other in ("article", "main") and not closed:
                    article = j
                if not closed:
                    inner[other] += 1
                elif inner[other]:
                    inner[other] -= 1
                elif within[other]:
                    return (j if article is None else article), False
                if own is None and article is not None:
                    return article, False
        return len(self.tags), False


class Lines:
    """The lines of one page: text, characters inside links, whether an article or main element holds them, and whether they
    begin in an element of BODY."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.linked: list[int] = []
        self.inside: list[bool] = []
        self.body: list[bool] = []
        self.in_body = False
        self.open: list[str] = []
        self.open_linked = 0
        self.links = self.articles = 0
        self.within: Counter[str] = Counter()  # open containers
        self._walk(page)

    def _line(self, gap: bool) -> None:
        text = " ".join("".join(self.open).split())
        if text:
            self._add(text, min(self.open_linked, len(text)))
        self.open, self.open_linked = [], 0
        if gap and self.text and self.text[-1]:
            for _ in range(WINDOW):
                self._add("", 0)

    def _add(self, text: str, linked: int) -> None:
        self.text.append(text)
        self.linked.append(linked)
        self.inside.append(self.articles > 0)
        self.body.append(self.in_body)

    def _write(self, text: str) -> None:
        if text:
            text = html.unescape(text)
            self.open.append(text)
            if self.links:
                self.open_linked += len(text.strip())

    def _walk(self, page: str) -> None:
        of = Page(page)
        tags, ends = of.tags, {of.closing.get(i) for i in of.articles}
        place, i = 0, 0
        while i < len(tags):
            m = tags[i]
            self._write(page[place:m.start()])
            place, at, tag, closed = m.end(), i, of.names[i], of.closed[i]
            i += 1
            if not tag:
                continue
            if tag in LINES:
                self._line(tag in CONTAINERS and tag not in DENSE)
                if tag != "br":
                    self.in_body = tag in BODY and not closed
            if tag == "a":
                self.links = max(0, self.links + (-1 if closed else 1))
            if at in of.articles or at in ends:
                self.articles = max(0, self.articles + (-1 if closed else 1))
            if tag in CONTAINERS:
                self.within[tag] = max(0, self.within[tag] + (-1 if closed else 1))
            if closed or tag in VOID:
                continue
            if of.sheds(at, self.articles > (at in of.articles)):
                if tag in CONTAINERS:
                    self.within[tag] -= 1
                end, own = of.end(at, self.within)
                if at in of.articles:
                    self.articles -= 1
                if tag == "a":
                    self.links -= 1
                place, i = (tags[end].end(), end + 1) if own else (tags[end].start(), end) if end < len(tags) else (len(page), end)
                if tag in CONTAINERS:
                    self._line(True)
        self._write(page[place:])
        self._line(False)


def main_text(page: str | None) -> str:
    """The article of a page, one line per block; empty if there is none."""
    if not page:
        return ""
    lines = Lines(page)
    size = np.array([len(t) for t in lines.text], dtype=np.int64)
    if not size.any():
        return ""
    linked = np.array(lines.linked, dtype=np.int64)
    windows = np.convolve(size, np.ones(WINDOW, dtype=np.int64))[WINDOW - 1:]  # line i and the ones after it
    ahead = np.concatenate((np.zeros(WINDOW - 1, dtype=np.int64), windows))
    live = np.flatnonzero(np.diff(np.concatenate(([0], (ahead > 0).astype(np.int8), [0]))))
    inside, body = np.array(lines.inside), np.array(lines.body)
    regions = []
    for start, dive in zip(live[::2] - WINDOW + 1, live[1::2]):
        own = np.flatnonzero(size[max(0, start):dive]) + max(0, start)
        if not len(own):
            continue
        held = bool(inside[own].any())
        if held or linked[own].sum() <= LINKS * size[own].sum():
            regions.append((own[0], own[-1], held, bool(held or windows[max(0, start):dive].max() >= SURGE or body[own].any())))
    places = [r for r in regions if r[2]] or [r for r in regions if r[3]] or regions
    return "\n".join(t for t in lines.text[places[0][0]:places[-1][1] + 1] if t) if places else ""


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """Adds text (the main text, empty if there is none) and n_chars to every row. A null page has no text. Pages are read
    whole; a column named like a result is replaced, others stay."""

    def kernel():
        def work(column):
            texts = [main_text(p) for p in column.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return append_columns(pages, [page], [("text", StringType()), ("n_chars", LongType())], kernel)
