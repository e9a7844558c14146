"""Operator 4: the main text of web pages.

The standard library's parser streams the page's events into lines, one for each block of text,
with the tags met since the line before and the characters inside links. Text-to-tag ratios of
the lines (text in links doesn't count) are smoothed by a Gaussian and split into two clusters;
lines of the upper cluster seed the content regions. A region grows over neighbouring lines of
the lower cluster, so short paragraphs, headings and lists of an article stay: as far as they lie in
the seed's own container or article, and are no list of links.

Tags only feed the ratio or veto: lines of elements that name themselves navigation, advert,
notice, form, comment and so on have ratio zero, are never content and end a region, unless a
name only describes a layout or the element holds a main element or nearly all of the text; and
where article or main elements hold most of the content, lines outside them are out.

Nulls: a null or empty page gives an empty text and 0. Cut-off and unclosed mark-up is read as
far as it goes. A page without any line above another is content as a whole. Very long pages are
whole. Repeated rows give a row each; no rows give none. Other columns are read only where `also`
names them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import strings_of, text_slices, texts_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never part of an article.
APART = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noscript object script search select style svg template textarea title".split())
#: Words of class, id and role that name something apart from the article.
NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|complementary|consent|contentinfo|cookie|cookies|disqus|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|promoted|promotion|related|replies|reply|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
#: Names that only describe a layout: has-sidebar, no-comments.
LAYOUT = re.compile(r"(?:^|[_-])(?:has|no|with|without)[_-]", re.I)
#: Elements of a head; any other one ends it.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
HOLDS_ARTICLE = frozenset({"article", "main"})
#: Elements that a content region doesn't leave by itself; others (lists, tables, quotes) are part of what holds them.
CONTAINERS = frozenset("html body main article section div center details dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Share of a line's text inside links that makes it a list of links.
LINKED = 0.6
#: Lines over which the ratio is smoothed, as a standard deviation.
SPREAD = 1.0


def names_apart(value: str) -> bool:
    return any(NAMES.search(x) and not LAYOUT.search(x) for x in value.split())


class Lines(HTMLParser):
    """Lines of a page: text, tags since the line before, whether it is apart, its open containers, and characters in links.

    `named` holds the block containers that are apart by their names only; lines don't count these.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, tuple[int, ...], int]] = []
        self.open: list[tuple[str, int, bool]] = []
        self.kinds: list[str] = []
        self.named: set[int] = set()
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.in_link = False

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append((text, self.tags, any(apart for tag, _, apart in self.open if tag in BLOCK), tuple(k for _, k, _ in self.open), self.linked))
            self.tags = 0
        self.linked = 0

    def end_head(self) -> None:
        self.cut()
        self.close_to("head")

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "a":
            self.in_link = True
        if tag == "body" or (self.open and self.open[-1][0] == "head" and tag not in IN_HEAD):
            self.end_head()
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK:
            self.cut()
        if tag in VOID:
            return
        named = tag not in ("html", "body", "article", "main") and any(k in ("class", "id", "role", "aria-label") and v and names_apart(v) for k, v in attrs)
        if tag in BLOCK or tag in APART or named or any(t == tag for t, _, _ in self.open):
            if tag == "p":  # a p ends an open p
                self.close_to("p", stop=BLOCK - {"p"})
            inside = any(t in HOLDS_ARTICLE for t, _, _ in self.open)
            hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
            apart = tag in APART or hidden or (tag == "header" and not inside)
            if named and tag in BLOCK and not apart:
                self.named.add(len(self.kinds))
            if tag == "main":  # what holds it is no side matter
                self.named.difference_update(k for _, k, _ in self.open)
            self.open.append((tag, len(self.kinds), apart or (named and tag not in BLOCK)))
            self.kinds.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_to(self, tag: str, stop: frozenset = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in stop:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        if tag == "a" or tag in CONTAINERS:
            self.in_link = False
        self.close_to(tag)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.end_head()
        if not any(apart and tag not in BLOCK for tag, _, apart in self.open):
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def smoothed(ratio: np.ndarray, spread: float = SPREAD) -> np.ndarray:
    """Gaussian over neighbouring lines; lines at the ends weigh what there is."""
    reach = int(np.ceil(3 * spread))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    cut = slice(reach, reach + len(ratio))
    return np.convolve(ratio, kernel)[cut] / np.convolve(np.ones(len(ratio)), kernel)[cut]


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Splits values in two by the mean of the two clusters' means, until it stays."""
    low, high = values.min(), values.max()
    if low == high:
        return np.ones(len(values), bool)
    cut = (low + high) / 2
    for _ in range(30):
        above = values > cut
        if above.all() or not above.any():
            break
        new = (values[above].mean() + values[~above].mean()) / 2
        if new == cut:
            break
        cut = new
    return values > cut


def grown(parser: Lines, lines: list[tuple], seeds: np.ndarray) -> np.ndarray:
    """The content: seeds, and lines of the lower cluster that belong to the seed before or after in the same run."""
    kinds = parser.kinds
    content = seeds.copy()

    def home(boxes: tuple[int, ...]) -> int:
        return next((b for b in reversed(boxes) if kinds[b] in CONTAINERS), -1)

    def belongs(line: tuple, seed: tuple) -> bool:
        text, boxes, linked = line[0], line[3], line[4]
        own, links = home(boxes), linked > LINKED * len(text)
        if own == home(seed[3]) and not (links and any(kinds[b] == "li" for b in boxes)):
            return True
        if not links and any(kinds[b] in HOLDS_ARTICLE and b in seed[3] for b in boxes):
            return True
        return any(kinds[b] in HEADINGS for b in boxes) and (own == -1 or own in seed[3])

    for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        seed = None
        for k in order:
            if lines[k][2]:
                seed = None  # what is apart ends a run
            elif seeds[k]:
                seed = lines[k]
            elif seed and not content[k]:
                content[k] = belongs(lines[k], seed)
    return content


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    whole = sum(len(line[0]) for line in parser.lines if not line[2])
    held = dict.fromkeys(parser.named, 0)
    for text, _, apart, boxes, _ in parser.lines:
        for box in () if apart else parser.named.intersection(boxes):
            held[box] += len(text)
    aside = {box for box, n in held.items() if n < 0.9 * whole}
    lines = [(text, tags, apart or not aside.isdisjoint(boxes), boxes, linked) for text, tags, apart, boxes, linked in parser.lines]
    free = np.array([not line[2] for line in lines], bool)
    if not free.any():
        return ""
    size = np.array([0 if apart else max(0, len(text) - linked) for text, _, apart, _, linked in lines], float)
    ratio = size / np.maximum(1, [line[1] for line in lines])
    content = grown(parser, lines, upper_cluster(smoothed(np.log1p(ratio))) & free)
    if not content.any():
        content = free
    length = np.array([len(line[0]) for line in lines])
    for kind in ("article", "main"):
        inside = np.array([any(parser.kinds[b] == kind for b in line[3]) for line in lines], bool)
        if length[content & inside].sum() > 0.5 * length[content].sum():
            content &= inside
            break
    return " ".join(lines[k][0] for k in np.flatnonzero(content))


def extract_pages(pages: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, and the columns named by `also` as they are."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            texts = [main_text(x) for x in strings_of(texts_of(part, "html"))]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *(part.column(c) for c in also)], ["page_id", "url", "text", "n_chars", *also])

    types = dict(pages.dtypes)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), *also)
    return rows.mapInArrow(extract, ", ".join(["page_id long, url string, text string, n_chars long", *(f"{c} {types[c]}" for c in also)]))
