"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with the path of block elements from the root to it. Over the blocks
of a path, text length and punctuation per block are aggregated and fused; the fused values are smoothed along the page
and a path is content if its mean reaches a share of their spread. Blocks below elements that announce themselves as
menus, headers, footers, sidebars, notices, adverts, forms or comments have the value 0 and are never content. A word in a
class, id or role, or a form, announces nothing about an element that holds the ``main`` or longest ``article`` element, or
most of the unlinked text of a page (unless one article outside it is there, or it holds comments), nor does a word behind
``has``, ``no``, ``with`` or ``without``; the ratios decide there. The
blocks of content paths are the text, wherever they lie; the other blocks beside a content path belong to it, and those of an
``article`` or ``main`` element that holds one, short ones included. If no path is content, an ``article`` or ``main`` element
with the most text is taken.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.
Defined results: null or empty html and pages without content give an empty text; unclosed and stray tags are
tolerated; repeated rows are extracted each; an empty table gives an empty result. Columns other than page_id, url and
html are not read. A page is handled in one piece whatever its length, in time proportional to it.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldwright.llm.common import bounded_batches

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr br img".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                           "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element that ends an open one of the second kind, up to one of the third.
IMPLIED_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
                "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
                "option": ({"option"}, {"select"})}
BOILERPLATE_TAGS = frozenset("head title nav header footer aside button select textarea menu dialog script style noscript "
                             "template iframe svg object canvas audio video".split())
CONTENT_TAGS = frozenset("article main".split())
#: Words of class, id and role that announce what is not the article.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "header masthead footer contentinfo sidebar aside complementary notice notices cookie cookies consent gdpr alert popup "
    "modal dialog overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond "
    "disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright legal "
    "disclaimer search form".split())
#: Words of what may be longer than the article.
DISCUSSION_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: Words behind these, in the same class, tell of another element.
ABOUT_OTHERS = frozenset("has no with without".split())
NEVER_BOILERPLATE = frozenset("html body main article".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|textarea|noscript|template|iframe|svg)\b[^<>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/<>]*)(?P<rest2>[^<>]*)>"
    r"|(?P<text>[^<]+|<)", re.I | re.S)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)
WORD = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Weights of the smoothing along the page, and the share of the spread that content must reach.
SMOOTHING = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
SHARE = 0.5


@dataclass(eq=False)
class Element:
    """An open element. ``marked``: its words announce boilerplate, which its text decides at the end of the page."""

    tag: str
    label: str
    away: bool
    marked: bool
    counts: bool
    discussion: bool
    #: The nearest marked element and the nearest article or main above.
    holder: Element | None
    article: Element | None
    #: Unlinked text inside; of an article without that of marked elements in it.
    size: int = 0
    inside: bool = False
    freed: bool = False
    removed: bool = False


class Blocks:
    """The text blocks of a page: path, text, characters inside links, whether an element above is boilerplate."""

    def __init__(self) -> None:
        self.read: list[tuple[tuple[str, ...], str, int, bool, Element | None]] = []
        self.open: list[Element] = []
        self.marked: list[Element] = []
        self.articles: list[Element] = []
        self.size = 0
        self.buffer: list[str] = []
        self.linked, self.links = 0, 0

    def flush(self) -> None:
        if self.buffer:
            text = " ".join(entities.unescape("".join(self.buffer)).split())
            if text:
                away = any(x.away for x in self.open)
                holder, article = self.nearest()
                if not away:
                    size = max(0, len(text) - self.linked)
                    self.size += size
                    if holder:
                        holder.size += size
                    if article and article.holder is holder:
                        article.size += size
                self.read.append((tuple(x.label for x in self.open), text, self.linked, away, holder))
            self.buffer, self.linked = [], 0

    def nearest(self) -> tuple[Element | None, Element | None]:
        """The nearest marked element and the nearest article or main that are open."""
        if not self.open:
            return None, None
        last = self.open[-1]
        return last if last.marked else last.holder, last if last.counts else last.article

    def start(self, tag: str, rest: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.buffer.append(" ")
            self.links += tag == "a"
            return
        self.flush()
        self.links = 0
        if tag in PARAGRAPH_ENDS:
            self.close({"p"}, {"table", "td", "th", "li", "div", "article", "section", "blockquote"})
        if tag in IMPLIED_ENDS:
            self.close(*IMPLIED_ENDS[tag])
        if tag in VOID:
            return
        words, announced = set(), set()
        for value in MARKS.findall(rest):
            for name in CAMEL.sub("-", value).lower().split():
                found = WORD.findall(name)
                words.update(found)
                announced.update(takewhile(lambda word: word not in ABOUT_OTHERS, found))
        away = tag in BOILERPLATE_TAGS or tag not in NEVER_BOILERPLATE and bool(rest) and bool(HIDDEN.search(rest))
        announced &= BOILERPLATE_WORDS
        marked = not away and tag not in NEVER_BOILERPLATE and (bool(announced) or tag == "form")
        label = ".".join([tag, *sorted(words)]) if words else tag
        counts = tag in CONTENT_TAGS and not announced
        element = Element(tag, label, away, marked, counts, not announced.isdisjoint(DISCUSSION_WORDS), *self.nearest())
        if marked:
            self.marked.append(element)
        elif counts:
            self.articles.append(element)
        self.open.append(element)

    def close(self, tags: set[str], up_to: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in up_to:
                return

    def end(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links = max(0, self.links - 1)
            return
        self.flush()
        self.links = 0
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def text(self, text: str) -> None:
        self.buffer.append(text)
        if self.links:
            self.linked += len(text)

    def free(self) -> None:
        """Find the marked elements that are no boilerplate after all."""
        for x in reversed(self.marked):
            if x.holder:
                x.holder.size += x.size
        for x in reversed(self.articles):
            if x.article and x.article.holder is x.holder:
                x.article.size += x.size
        longest = max((x for x in self.articles if x.tag == "article"), key=lambda x: x.size, default=None)
        filled = [x for x in self.articles if x.size]
        for x in filled:
            holder = x.holder if x.tag == "main" or x is longest else None
            while holder and not holder.freed:
                holder.freed, holder = True, holder.holder
        for x in self.articles:
            x.inside = len(filled) != 1 or x is filled[0] or bool(x.article and x.article.inside)
        for x in self.marked:
            elsewhere = len(filled) == 1 and not (x.article and x.article.inside)
            x.freed |= 2 * x.size > self.size and not x.discussion and not elsewhere
            x.removed = not x.freed or bool(x.holder and x.holder.removed)

    def found(self) -> list[tuple[tuple[str, ...], str, int, bool]]:
        self.flush()
        self.free()
        return [(path, text, linked, away or bool(holder and holder.removed)) for path, text, linked, away, holder in self.read]


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int, bool]]:
    reader = Blocks()
    for match in TOKEN.finditer(page):
        if (text := match["text"]) is not None:
            reader.text(text)
        elif tag := match["tag"] or match["tag2"]:
            if match["end"] or match["end2"]:
                reader.end(tag.lower())
            else:
                reader.start(tag.lower(), match["rest"] or match["rest2"] or "")
    return reader.found()


def content_paths(found: list[tuple[tuple[str, ...], str, int, bool]]) -> set[tuple[str, ...]]:
    """The paths whose smoothed, fused ratios of text and punctuation reach the threshold."""
    chars, marks, nodes, linked = (defaultdict(int) for _ in range(4))
    for path, text, in_links, away in found:
        nodes[path] += 1
        chars[path] += len(text)
        linked[path] += min(in_links, len(text))
        marks[path] += 0 if away else len(PUNCTUATION.findall(text))
    away_paths = {path for path, _, _, away in found if away}
    fused = {p: 0.0 if p in away_paths else (chars[p] - linked[p]) / n * (1 + marks[p] / n) for p, n in nodes.items()}
    raw = np.log1p([fused[path] for path, *_ in found])
    smooth = np.convolve(np.pad(raw, 2, mode="edge"), SMOOTHING, mode="valid")
    total = defaultdict(float)
    for (path, *_), value in zip(found, smooth):
        total[path] += value
    least = SHARE * float(smooth.std())
    return {p for p, n in nodes.items() if p not in away_paths and fused[p] > 0 and total[p] / n >= least}


def _tag(label: str) -> str:
    return label.partition(".")[0]


def _article(path: tuple[str, ...]) -> tuple[str, ...] | None:
    """The path of the outermost article or main element of ``path``."""
    return next((path[:k + 1] for k, label in enumerate(path) if _tag(label) in CONTENT_TAGS), None)


def main_text(page: str | None) -> str:
    """The article of a page."""
    found = blocks(page or "")
    if not found:
        return ""
    chosen = content_paths(found)
    if not chosen:
        weight = defaultdict(int)
        for path, text, _, away in found:
            if not away and (top := _article(path)):
                weight[top] += len(text)
        top = max(sorted(weight), key=weight.__getitem__, default=None)
        return "\n\n".join(text for path, text, _, away in found if top and not away and path[:len(top)] == top)
    beside = {p[:-1] for p in chosen}
    articles = {_article(p) for p in chosen} - {None}
    return "\n\n".join(text for path, text, in_links, away in found
                       if not away and (path in chosen or path[:-1] in beside and 2 * in_links < len(text)
                                        or _article(path) in articles))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(x) for x in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
