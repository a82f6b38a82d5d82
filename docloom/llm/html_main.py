"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; blocks of text between block-level tags are the
lines. Each line has a ratio of its characters to its tags, the ratios are smoothed by a Gaussian,
and lines over a threshold of one standard deviation form the content cluster, but for those whose
own ratio is under a tenth of it.

The cluster decides twice. A container whose class, id or role speaks of menus, adverts, comments
and the like, and a form, is out, unless it holds a larger part of the page's content than its
names speak against it: a wrapper that is called `content has-sidebar` holds the article and stays.
Then the content lines that are left choose the region of the page: the article or else the main
element that holds more than half of them, by characters, or the innermost container of all of
them. All remaining lines of that region are its text, short ones too. Elements that HTML has for
something else (nav, aside, footer, scripts, fields, what is hidden) are out in any case.

Each page is one row of one task: no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.wordhash import text_slices

SIGMA, RADIUS = 1.0, 2
#: Part of the threshold that a content line's own ratio must reach for the region to hold the line.
OWN = 0.1

# fixed values: what HTML says about its elements
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPEN = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu nav ol section table tbody td template th tr ul".split())
_BLOCK = _OPEN | frozenset("address br caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr li p pre summary thead tfoot".split())
_REGION = frozenset("article body center div fieldset form html main section".split())
_SELF_CLOSING = frozenset("p li dd dt option".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# fixed values: elements that never hold the article
_OUT = frozenset("aside audio button canvas datalist dialog embed footer head iframe input label menu math nav noscript object option script select style svg template textarea title video".split())
# fixed values: words of class, id and role that mark what is not the article
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup login sidebar sidebars aside rail widget widgets related recommended "
    "recommendations share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation topbar toolbar masthead header footer foot comment comments commentlist reply replies "
    "respond disqus pagination pager skip copyright disclaimer legal complementary contentinfo search".split()
)
#: Part of the page's content that a container must hold to stay: without a name against it, and for all names.
STAY, STAY_MORE = 0.25, 0.65
#: What a form has against it by being one.
FORM = 0.5
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_TAG = re.compile(r"<[/a-zA-Z!?]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _against(tag: str, attrs: list[tuple[str, str | None]]) -> float:
    """The part of an element's names that speak against it, by the attribute that speaks most; over 1: hidden."""
    most = FORM if tag in ("form", "fieldset") else 0.0
    for name, value in attrs:
        if name == "hidden":
            return 2.0
        if not value:
            continue
        if name in ("class", "id", "role"):
            words = _WORDS.findall(_CAMEL.sub(r"\1 \2", value).lower())
            if words:
                most = max(most, sum(w in _MARKS for w in words) / len(words))
        elif name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value.lower()):
            return 2.0
    return most


class _Open(NamedTuple):
    """An open element; out: in what is not the article, inside: in an article or main element, header:
    out only because of a header of the article."""

    tag: str
    number: int
    out: bool
    inside: bool
    header: bool


class _Lines(HTMLParser):
    """Lines of a page as (text, tags, number of the innermost element); elements by number: (tag, parent,
    what its names have against it), parents first. What an event costs does not grow with the depth of nesting, but for elements it closes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.elements: list[tuple[str, int, float]] = [("", -1, 0.0)]
        self.stack: list[_Open] = [_Open("", 0, False, False, False)]
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.tags = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.stack[-1].number))
            self.tags = 0
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1
        if tag in _VOID:
            return
        top = self.stack[-1]
        if tag in _BLOCK and top.tag in _SELF_CLOSING and (tag not in ("ul", "ol", "dl", "div") or top.tag == "p"):
            self._pop(len(self.stack) - 1)
        _, parent, out, inside, header = self.stack[-1]
        against = 0.0 if tag in ("html", "body", "main") or tag in _HEADING or tag == "article" and not inside else _against(tag, attrs)
        # a name inside a line of text, and what is hidden, is out; a container is judged when all is read
        bad = tag in _OUT or tag == "header" and not out or against > 1 or against > 0 and tag not in _BLOCK
        if out and header and tag in _HEADING:
            bad, out, header = False, False, False  # the heading of an article that stands in the article's own header
        elif out:
            header = header and tag in ("header", "div", "section")
        elif bad:
            header = inside and tag == "header"
        if bad or out or against or tag in _OPEN or tag in _SELF_CLOSING or tag in _HEADING:
            self.elements.append((tag, parent, against))
            self.stack.append(_Open(tag, len(self.elements) - 1, out or bad, inside or tag in ("article", "main"), header))
            self.open[tag] += 1

    def _pop(self, i: int) -> None:
        for x in self.stack[i:]:
            self.open[x.tag] -= 1
        del self.stack[i:]

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if any(x.tag in _BLOCK for x in self.stack[i:]):
                    self._end_line()
                self._pop(i)
                return
            if self.stack[i].tag in _OPEN and tag not in _OPEN:
                return  # an end tag of text level doesn't end an element around it

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1

    def handle_data(self, data):
        if not self.stack[-1].out:
            self.parts.append(data)


def smoothed(ratios: list[float]) -> list[float]:
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    kernel = [k / sum(kernel) for k in kernel]
    n = len(ratios)
    # at the edges the nearest line stands in for those beyond
    return [sum(w * ratios[min(max(i + k - RADIUS, 0), n - 1)] for k, w in enumerate(kernel)) for i in range(n)]


def content_lines(ratios: list[float]) -> list[bool]:
    """The cluster of lines whose smoothed ratio is over the standard deviation; the top lines if none is.

    A line far under it, which only its neighbours lift, is no part: it may be a teaser's heading."""
    level = smoothed(ratios)
    mean = sum(level) / len(level)
    bar = math.sqrt(sum((x - mean) ** 2 for x in level) / len(level))
    found = [x > bar and own >= OWN * bar for x, own in zip(level, ratios, strict=True)]
    return found if any(found) else [x == max(level) for x in level]


def without_cut_tag(html: str) -> str:
    """html without a last tag that no > ends."""
    end = html.rfind(">") + 1
    cut = _TAG.search(html, end)
    return html[: cut.start()] if cut else html


def main_text(html: str) -> str:
    """The main text of a page; empty if there is none."""
    parser = _Lines()
    parser.feed(without_cut_tag(html))
    parser.close()
    parser._end_line()
    elements = parser.elements
    lines = _without_marked(parser.lines, elements)
    if not lines:
        return ""
    held = _held(lines, elements)
    depth = [0] * len(elements)
    for n in range(1, len(elements)):
        depth[n] = depth[elements[n][1]] + 1
    region = next((n for tag in ("article", "main") for n in range(len(elements)) if elements[n][0] == tag and 2 * held[n] > held[0]), None)
    if region is None:
        region = max((n for n in range(len(elements)) if held[n] == held[0]), key=lambda n: (depth[n], n))
        while elements[region][0] not in _REGION and elements[region][1] >= 0:
            region = elements[region][1]  # a paragraph, quote, list or table is no region
    inside = [False] * len(elements)
    for n in range(len(elements)):
        inside[n] = n == region or n > 0 and inside[elements[n][1]]
    return " ".join(text for text, _, at in lines if inside[at])


def _held(lines: list[tuple[str, int, int]], elements: list[tuple[str, int, float]]) -> list[int]:
    """Characters of content lines in each element."""
    held = [0] * len(elements)
    content = content_lines([len(text) / max(1, tags) for text, tags, _ in lines])
    for (text, _, at), good in zip(lines, content, strict=True):
        held[at] += len(text) if good else 0
    for n in range(len(elements) - 1, 0, -1):
        held[elements[n][1]] += held[n]
    return held


def _without_marked(lines: list[tuple[str, int, int]], elements: list[tuple[str, int, float]]) -> list[tuple[str, int, int]]:
    """lines but for those in containers whose names have more against them than their content is worth."""
    if not lines or not any(against for _, _, against in elements):
        return lines
    held = _held(lines, elements)
    gone = [False] * len(elements)
    for n in range(1, len(elements)):
        _, parent, against = elements[n]
        gone[n] = gone[parent] or against > 0 and held[n] <= (STAY + STAY_MORE * against) * held[0]
    return [x for x in lines if not gone[x[2]]]


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, with text and n_chars (its code points).

    Null, empty and unparseable pages have an empty text. Other columns are carried as they are,
    but text and n_chars are replaced. An empty table gives an empty result.
    """
    carried = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(carried)
            for row, offsets, data in text_slices(batch.column(batch.schema.get_field_index(html))):
                whole, at = data.tobytes(), offsets.tolist()
                texts = [main_text(whole[a:b].decode("utf-8", "replace")) for a, b in zip(at[:-1], at[1:], strict=True)]
                part = rest.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=[*carried, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in carried)
    return pages.select(*carried, F.col(html).cast("string").alias(html)).mapInArrow(run, f"{fields}{', ' if fields else ''}text string, n_chars long")
