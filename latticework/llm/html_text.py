"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering.

Each page streams through the standard library's parser, which yields lines (the
text of one block) with the number of tags met on the way.  The logarithms of
the lines' text-to-tag ratios, without text behind links, are smoothed by a
Gaussian over the page.  A region (the lines that share a container) is content
when one of its smoothed values, times the weight of the names around it,
reaches the standard deviation of the page's smoothed values; lines are kept or
left out with their region.

Names of elements and classes are weights.  A name made of nothing but words for
page furniture weighs so much that only text of thousands of characters a tag outvotes it: reader
comments are prose like the article's, and no ratio tells them apart.  A name
in which such a word stands beside others is a doubt that a few dozen characters
a tag outvote, inside an article a handful.  A form that holds most
of the page's text is the page's wrapper and no form.  Scripts, styles and the
like have no lines; hidden elements weigh nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and class words as HTML and common templates use them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr",
}
SKIPPED = {
    "button", "canvas", "head", "iframe", "noscript", "object", "option", "script", "select", "style", "svg", "template",
    "textarea", "title",
}
RAW = {"script", "style"}
UNLIKELY = {"aside", "dialog", "footer", "menu", "nav"}
UNLIKELY_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation",
    "newsletter", "pagination", "popup", "promo", "promoted", "replies", "reply", "respond", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar",
}
#: Words for the shape of a part; beside an unlikely word they say nothing of the text.
SHAPE_WORDS = {
    "aside", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "count", "entry", "fixed",
    "form", "group", "head", "icons", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "media", "mobile", "outer",
    "page", "panel", "post", "right", "row", "section", "site", "slot", "small", "sticky", "text", "thread", "top", "unit", "user", "wrap",
    "wrapper", "zone",
}
#: Words that also name parts of articles: full weight only as a whole class outside of them.
DOUBTFUL_WORDS = {
    "alert", "banner", "copyright", "disclaimer", "header", "notice", "notices", "recommended", "related", "search",
    "skip", "tags", "widget",
}
UNLIKELY_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "navigation", "search"}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "blockquote"}
#: Weights of an unlikely name, of a form, of a doubtful word in a longer class name, and of one inside an article.
#: Against a threshold of 1 they are outvoted at 4,200, 150, 54 and 5 characters a tag.
UNLIKELY_WEIGHT, FORM_WEIGHT, DOUBTFUL_WEIGHT, INSIDE_WEIGHT = 0.12, 0.2, 0.25, 0.6
#: Share of a page's text, links apart, above which a form is the page's wrapper.
WRAPPER_SHARE = 0.5
#: Half width of the smoothing window, in lines, and the Gaussian's deviation.
RADIUS, SIGMA = 2, 1.0
#: Least value of content: the logarithm of a ratio of 1.7.
FLOOR = 1.0
#: Characters given to the parser at once.
FEED = 1 << 16


def name_weight(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> float:
    """What the names of an element say of its text: 1 nothing, less that it is no content, 0 that it is hidden."""
    named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden")}
    if "hidden" in named or named.get("aria-hidden") == "true":
        return 0.0
    if tag in UNLIKELY or tag == "header" and not inside or named.get("role") in UNLIKELY_ROLES:
        return UNLIKELY_WEIGHT
    weight = 1.0
    for name in f"{named.get('class', '')} {named.get('id', '')}".lower().split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if not UNLIKELY_WORDS.isdisjoint(words):
            if words <= UNLIKELY_WORDS | SHAPE_WORDS:
                return UNLIKELY_WEIGHT
            weight = min(weight, INSIDE_WEIGHT if inside else DOUBTFUL_WEIGHT)
        if not DOUBTFUL_WORDS.isdisjoint(words):
            whole = len(words) == 1
            weight = min(weight, (INSIDE_WEIGHT if whole else 1.0) if inside else UNLIKELY_WEIGHT if whole else DOUBTFUL_WEIGHT)
    return weight


Line = tuple[str, int, int, int, float, int]


class LineEvents(HTMLParser):
    """Turns parser events into (text, tags, link characters, region, weight, forms around it) lines.

    An element is opened and closed once, so the work grows with the page however
    its elements nest or stay open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, float, int]] = []  # element; region, weight and depth in articles before it
        self.count: Counter[str] = Counter()
        self.region, self.weight, self.inside = 0, 1.0, 0
        self.made = self.skips = self.tags = self.linked = 0
        self.link = False
        self.words: list[str] = []

    def break_line(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.region, self.weight, self.count["form"]))
        self.words.clear()
        self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.break_line()
        self.tags += 1
        if tag == "br":
            self.words.append(" ")
        if tag == "a":
            self.link = True
        if tag in VOID or tag in INLINE:
            return
        self.open.append((tag, self.region, self.weight, self.inside))
        self.count[tag] += 1
        self.skips += tag in SKIPPED
        own = name_weight(tag, attrs, self.inside > 0)
        if tag in CONTAINERS or tag == "form" or own != 1.0:
            self.made += 1
            self.region = self.made
        self.weight *= own
        self.inside += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.break_line()
        self.tags += 1
        if tag == "a":
            self.link = False
        if not self.count[tag]:
            return
        while True:
            name, self.region, self.weight, self.inside = self.open.pop()
            self.count[name] -= 1
            self.skips -= name in SKIPPED
            if name in CONTAINERS:
                self.link = False
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.skips:
            self.words.append(data)
            if self.link:
                self.linked += len("".join(data.split()))


def smooth(values: list[float], radius: int = RADIUS, sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; at the ends the weights inside the page are renormalised."""
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in zip(range(i - radius, i + radius + 1), kernel, strict=True):
            if 0 <= k < len(values):
                total += w * values[k]
                weight += w
        out.append(total / weight)
    return out


def content(lines: list[Line]) -> list[bool]:
    """Which lines belong to a content region.

    A line with nothing but links speaks for no region, whatever stands beside it.
    """
    if not lines:
        return []
    own = [max(0, len(text) - text.count(" ") - linked) for text, _, linked, *_ in lines]
    raw = [math.log1p(n / max(1, line[1])) for n, line in zip(own, lines, strict=True)]
    wrapped = sum(n for n, line in zip(own, lines, strict=True) if line[5]) > WRAPPER_SHARE * sum(own)
    smoothed = smooth(raw)
    mean = sum(smoothed) / len(smoothed)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in smoothed) / len(smoothed))
    best: dict[int, float] = {}
    for value, alone, line in zip(smoothed, raw, lines, strict=True):
        weight = line[4] * (FORM_WEIGHT if line[5] and not wrapped else 1.0)
        best[line[3]] = max(best.get(line[3], 0.0), value * weight if alone else 0.0)
    threshold = max(FLOOR, min(deviation, max(best.values())))
    return [best[line[3]] >= threshold for line in lines]


def open_comment(html: str) -> int | None:
    """Where a comment begins that is never closed, if one does; scripts and the like hold no comments.

    The parser would look for the end of each of many open comments anew.
    """
    at = html.find("<!--", html.rfind("-->") + 1)
    while at >= 0:
        raw = max(((html.rfind(f"<{tag}", 0, at), tag) for tag in RAW), default=(-1, ""))
        if raw[0] < 0 or html.find(f"</{raw[1]}", raw[0], at) >= 0:
            return at
        end = html.find(f"</{raw[1]}", at)
        if end < 0:
            return None
        at = html.find("<!--", end)
    return None


def page_lines(html: str) -> list[Line]:
    """The lines of a page.  A comment that is never closed goes on to its end."""
    events, html = LineEvents(), html[: open_comment(html)]
    for at in range(0, len(html), FEED):
        events.feed(html[at : at + FEED])
    events.close()
    events.break_line()
    return events.lines


def main_text(html: str) -> str:
    """The content blocks of one page, joined by line ends; empty if there are none."""
    lines = page_lines(html)
    return "\n".join(line[0] for line, kept in zip(lines, content(lines), strict=True) if kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page, from its whole html.

    A null or empty html, and a page without content, give an empty text.  Rows
    are independent: nulls and repeats pass through.  Other columns are ignored.
    """

    def extract(col: pd.Series) -> pd.Series:
        return col.map(lambda html: main_text(html) if html else "")

    text = F.pandas_udf(extract, "string")(F.coalesce("html", F.lit("")))
    return pages.select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
