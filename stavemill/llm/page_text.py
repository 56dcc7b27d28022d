"""Main text of web pages by text-to-tag ratios.

Streaming events of the standard library's parser cut a page into lines: the text between block-level
tags, with the number of tags met on the way. The ratio of characters to tags, smoothed by a Gaussian
over neighbouring lines, is clustered by a threshold (its standard deviation): lines above are content.
The first content region is the innermost ``article`` or ``main`` with at least half of their characters, else
the innermost container with nine tenths. Content lines outside it make further regions: beside the first
one and the elements around it, the innermost container of the content lines of each element (lines without
one stand for themselves). All lines of the regions are the text, in page order, short ones included. Menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, scripts, styles and hidden parts are left
out by element, role or class, and do not count for the ratios; a class counts only if all its words name or
frame such a part.

Defined cases: null and empty html give an empty text; broken markup is read as the parser reads it, marked
sections it cannot read are left out up to their end, an
``article`` or ``main`` ends unclosed menus and the like before it, and end tags without a start are ignored; a
page whose lines all lie below the threshold has its longest line as content; deep nesting takes linear time;
whole pages are parsed, one
batch of pages is in memory at a time; equal rows give equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import register, small_batches, table

SIGMA, RADIUS = 1.0, 2
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article body center div fieldset html main section table tbody td tr".split())
OUT = frozenset("aside button dialog footer form head header iframe menu nav noscript object script "
                "select style svg template textarea title".split())
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter "
    "notice notices popup promo promotion related respond share sharing sidebar social sponsor "
    "sponsored subscribe subscription toolbar widget".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar "
                      "navigation search".split())
REMARKS = frozenset(("comment", "comments", "disqus", "respond"))
#: Words in a class name that place or frame what another of its words names.
FRAMES = frozenset("area bar block bottom box container fixed frame global inner left list main page panel reader "
                   "right section site sticky top user wrap wrapper".split())
_NAME = re.compile(r"[a-z]+")


def _names(value: str, wanted: frozenset[str]) -> bool:
    """Whether a class or id says that its element is one of ``wanted``: a name of its own, or with words that
    only place or frame it. ``ad-box`` is an advert, ``content-with-ads`` is not."""
    for name in value.split():
        words = _NAME.findall(name)
        if not wanted.isdisjoint(words) and (wanted | FRAMES).issuperset(words):
            return True
    return False


class _Page(HTMLParser):
    """Collects lines: (text, tags, innermost container or -1). Containers have numbers in page order; ``tag``
    and ``parent`` are by number."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.tag: list[str] = []
        self.parent: list[int] = []
        #: Open elements: tag, innermost container, why they are left out ('' if not), themselves or around.
        self.open: list[tuple[str, int, str]] = []
        self.count: dict[str, int] = {}
        self.text: list[str] = []
        self.tags = 0

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section that is none: left out up to its end, like any unknown one
            return self.parse_bogus_comment(i)

    def left_out(self) -> str:
        return self.open[-1][2] if self.open else ""

    def leave(self, at: int) -> None:
        for tag, _, _ in self.open[at:]:
            self.count[tag] -= 1
        del self.open[at:]

    def cut(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            self.lines.append((line, self.tags, self.open[-1][1] if self.open else -1))
            self.tags = 0
        self.text.clear()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
        elif tag == "br":
            self.text.append(" ")
        if tag in ("article", "main") and self.left_out() not in ("", "remarks"):
            while self.open and self.left_out():
                self.leave(len(self.open) - 1)
        if not self.left_out():
            self.tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):
            self.close_like(tag)
        why = "out" if tag in OUT else ""
        facts = {k: (v or "").lower() for k, v in attrs}
        if not why and tag not in ("html", "body", "article", "main"):
            names = facts.get("class", "") + " " + facts.get("id", "")
            if _names(names, REMARKS):
                why = "remarks"
            elif _names(names, OUT_NAMES) or facts.get("role") in OUT_ROLES or "hidden" in facts or \
                    facts.get("aria-hidden") == "true" or \
                    "display:none" in facts.get("style", "").replace(" ", ""):
                why = "out"
        elif not why and tag == "article" and _names(facts.get("class", ""), REMARKS):
            why = "remarks"
        inside = self.open[-1][1] if self.open else -1
        if tag in CONTAINERS:
            self.tag.append(tag)
            self.parent.append(inside)
            inside = len(self.tag) - 1
        self.open.append((tag, inside, self.left_out() or why))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_like(self, tag: str) -> None:
        """A new item ends an open one of its kind, unless another block lies between (a paragraph
        does not count for other items)."""
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, -1, -1):
            own = self.open[i][0]
            if own == tag:
                self.leave(i)
                return
            if own in BLOCKS and (own != "p" or tag == "p"):
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.cut()
        if not self.left_out():
            self.tags += 1
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.leave(i)
                return
            if self.open[i][0] in ("article", "main", "body") and tag not in (
                    "article", "main", "body", "html"):
                return

    def handle_data(self, data):
        if not self.left_out():
            self.text.append(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights inside are scaled up."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[RADIUS:-RADIUS]
    return np.convolve(ratios, kernel)[RADIUS:-RADIUS] / weight


def content_lines(size: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines are content, by their characters and tags."""
    ratio = smoothed(size / np.maximum(1, tags))
    content = ratio >= ratio.std()
    return content if content.any() else size == size.max()


def _common(parent: list[int], depth: list[int], a: int, b: int) -> int:
    """The innermost container around both."""
    while a != b:
        if depth[a] >= depth[b]:
            a = parent[a]
        else:
            b = parent[b]
    return a


def main_text(html: str | None) -> str:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.cut()
    if not page.lines:
        return ""
    size = np.array([len(t) for t, _, _ in page.lines], float)
    content = content_lines(size, np.array([n for _, n, _ in page.lines]))
    tag, parent, n = page.tag, page.parent, len(page.tag)
    held, depth = [0.0] * n, [0] * n
    for (_, _, own), chars, inside in zip(page.lines, size, content):
        if inside and own >= 0:
            held[own] += chars
    total = float(size[content].sum())
    for i in range(n - 1, -1, -1):  # a container comes after the one around it
        if parent[i] >= 0:
            held[parent[i]] += held[i]
    for i in range(n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
    region = [i for i in range(n) if tag[i] in ("article", "main") and held[i] and held[i] >= total / 2] or \
        [i for i in range(n) if held[i] and held[i] >= 0.9 * total - 1e-9]
    inner = max(region, key=lambda i: (depth[i], i)) if region else None
    if inner is None:
        return "\n".join(t for t, _, _ in page.lines)
    above, i = {-1}, parent[inner]
    while i >= 0:
        above.add(i)
        i = parent[i]
    # Content elsewhere: per element beside the region, the innermost container around its content lines, which
    # is that of the first and the last in page order.
    branch = [-1] * n
    for i in range(n):
        if i not in above:
            branch[i] = i if parent[i] in above else branch[parent[i]]
    ends: dict[int, tuple[int, int]] = {}
    for (_, _, own), inside in zip(page.lines, content):
        if inside and own not in above and branch[own] != inner:
            first, last = ends.get(branch[own], (own, own))
            ends[branch[own]] = min(first, own), max(last, own)
    kept = {inner} | {_common(parent, depth, a, b) for a, b in ends.values()}
    within = [False] * n
    for i in range(n):
        within[i] = i in kept or (parent[i] >= 0 and within[parent[i]])
    return "\n".join(t for (t, _, own), inside in zip(page.lines, content)
                     if (own >= 0 and within[own]) or (inside and own in above))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the column text in place of the html."""
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(h) for h in s], dtype="object")

    small_batches(pages.sparkSession)
    return pages.withColumn("text", extract(html)).drop(*({html} - {"text"}))


@register("op4_html_extraction")
def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text",
                                   F.char_length("text").cast("long").alias("n_chars"))
