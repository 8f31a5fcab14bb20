"""Main text of web pages: parser events, text-to-tag ratios, smoothing and threshold clustering.

The standard library's parser streams a page into lines, one a block. Each line has a ratio of its text outside of links to the
tags in it; the ratios are smoothed with a Gaussian over the lines, in which borders of containers count as distance, so
a short paragraph has the ratio of the article around it and a footer its own. The logarithm of the ratio is the line's evidence;
elements that are typed or named as boilerplate, and articles and headings, shift it. A threshold that splits the page's lines
into two clusters, held within bounds for pages of one kind, picks the content lines, and lines in between the thresholds join
content lines next to them. Only what can't be text (scripts, styles, hidden parts) is left out beforehand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content isn't text of the page.
OUTSIDE = frozenset("head title script style noscript template button select textarea option label iframe object svg math canvas".split())
CLOSES_P = BLOCK - {"body", "html"}
#: Of these, the ones that a block inside ends, as it was most likely meant to stand behind them; an option's own kind aside.
SHORT = ("label", "button", "option")
#: Where a search for the end of an item stops.
LISTS = ("ul", "ol", "menu", "table", "select", "dl", "tr")
#: Elements that shift and lie within each other, at most: deeper ones add nothing to those around them.
MOST_SHIFTED = 256
#: Elements whose borders count as distance.
CONTAINERS = frozenset("article main section div body td blockquote nav aside footer header menu form dialog".split())
#: Shifts of evidence, in units of the logarithm: by kind of element, and by names of class, id and role.
SHIFTS = {"nav": -6.0, "menu": -6.0, "footer": -6.0, "aside": -6.0, "dialog": -6.0, "form": -8.0, "header": -4.0, "article": 1.0, "main": 1.0}
KINDS = frozenset(["nav", "menu", "footer", "aside", "dialog"])
HEADINGS, HEADING_SHIFT = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"]), 1.5
STRONG, WEAK = -6.0, -3.0
#: Bounds of the threshold.
LOW, HIGH = 2.5, 4.0


def _names(words: str) -> re.Pattern:
    return re.compile(r"(?:site[_-])?(?:WORD)(?:[_-](?:WORD))*".replace("WORD", words), re.I)


_SURE = (
    r"ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|menu[a-z]*|nav[a-z]*|breadcrumb[a-z]*|sidebar|footer|masthead|cookies?|consent|newsletter|subscribe|"
    r"comments?|disqus|repl(?:y|ies)|pagination|pager|navigation|contentinfo|complementary"
)
_LIKELY = r"banner|side|header|notices?|alert|popup|modal|signup|login|share|sharing|social|related|recommend[a-z]*|widget|toolbar|search"
#: A name counts if all its parts do, so "has-sidebar" and "related-work" don't.
STRONG_NAMES, WEAK_NAMES = _names(_SURE), _names(f"{_SURE}|{_LIKELY}")


@dataclass
class Line:
    """A block's text, with the tags and characters of links in it, the number of its container and those of the elements that shift it."""

    text: str
    tags: int
    linked: int
    container: int
    shifted: tuple[int, ...]
    heading: bool


class PageReader(HTMLParser):
    """Collects the lines of a page. Places of open elements are kept for each tag, so an event costs as much as it closes, however many are open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        #: open elements: tag, container, whether it or one above is no text, elements that shift
        self.open: list[tuple[str, int, bool, tuple[int, ...]]] = [("page", 0, False, ())]
        #: places in ``open`` by tag, those of all blocks, and how many headings are open
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.headings = 0
        #: tag and shift of each element that shifts
        self.shifts: list[tuple[str, float]] = []
        #: the container around each container, and how many lie around it
        self.around, self.depth = [0], [0]
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these, 0 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close_from(self, place: int) -> None:
        """Close the element at a place and all within it."""
        for tag, *_ in reversed(self.open[place:]):
            self.at[tag].pop()
            self.headings -= tag in HEADINGS
            if tag in BLOCK:
                self.blocks.pop()
        del self.open[place:]

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        _, container, _, shifted = self.open[-1]
        if text:
            self.lines.append(Line(text, self.tags, self.linked, container, shifted, self.headings > 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
            while tag not in ("option", "optgroup") and (short := self.last(*SHORT)) and short >= self.last("td", "th"):
                self.close_from(short)
            if tag in CLOSES_P and self.open[-1][0] == "p":
                self.close_from(len(self.open) - 1)
            if tag in ("li", "option", "dt", "dd", "tr", "td", "th"):
                self._close_sibling(tag)
        else:
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
        if tag in VOID:
            return
        _, container, outside, shifted = self.open[-1]
        held = self.last("article", "main") > 0
        shift = 0.0 if tag in ("header", "article", "main") and held else SHIFTS.get(tag, 0.0)
        outside = outside or tag in OUTSIDE
        for k, v in attrs:
            if k in ("class", "id", "role") and v and tag not in ("body", "html", "main"):
                named = [STRONG if STRONG_NAMES.fullmatch(x) else WEAK for x in v.split() if WEAK_NAMES.fullmatch(x)]
                shift = min([shift, *named])
            elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and re.search(r"display\s*:\s*none", v)):
                outside = True
        if shift and len(shifted) < MOST_SHIFTED:
            shifted = (*shifted, len(self.shifts))
            self.shifts.append((tag, shift))
        if tag in CONTAINERS:
            self.around.append(container)
            self.depth.append(self.depth[container] + 1)
            container = len(self.around) - 1
        self.at.setdefault(tag, []).append(len(self.open))
        self.headings += tag in HEADINGS
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, container, outside, shifted))

    def _close_sibling(self, tag: str) -> None:
        """An item ends where the next of its list begins."""
        ends = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, (tag,))
        place = self.last(*ends)
        if place and place >= self.last(*[t for t in LISTS if (tag, t) != ("tr", "table")]):
            self.close_from(place)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        else:
            self.tags += 1
        place = self.last(tag)
        if not place:
            return
        # an inline end doesn't close blocks, but that of an element without text closes it, except across a table's cell
        inner = self.last("td", "th") if tag in OUTSIDE else self.blocks[-1] if self.blocks and tag not in BLOCK else 0
        if place >= inner:
            self.close_from(place)

    def handle_data(self, data: str) -> None:
        if not self.open[-1][2]:
            self.parts.append(data)
            if self.at.get("a"):
                self.linked += len(data.strip())


def smooth(x: np.ndarray, at: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing of values at rising places, over three on either side."""
    total, weight = x.copy(), np.ones(len(x))
    for k in range(1, min(4, len(x))):
        w = np.exp(-0.5 * ((at[k:] - at[:-k]) / sigma) ** 2)
        total[:-k] += w * x[k:]
        weight[:-k] += w
        total[k:] += w * x[:-k]
        weight[k:] += w
    return total / weight


def two_clusters(x: np.ndarray) -> float:
    """The threshold halfway between the means of the two clusters that it makes."""
    t = float(x.mean())
    for _ in range(50):
        low, high = x[x < t], x[x >= t]
        new = (float(low.mean() if len(low) else x.min()) + float(high.mean() if len(high) else x.max())) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def places(lines: list[Line], around: list[int], depth: list[int]) -> np.ndarray:
    """Where each line is: one after the line before, and one more for each container that ends or begins between them."""
    step = [0]
    for a, b in zip(lines, lines[1:], strict=False):
        x, y = a.container, b.container
        while x != y:  # the deeper one climbs; all that is climbed lies between the two lines
            if depth[x] >= depth[y]:
                x = around[x]
            else:
                y = around[y]
        step.append(1 + depth[a.container] + depth[b.container] - 2 * depth[x])
    return np.cumsum(step)


def shifts_of(lines: list[Line], shifts: list[tuple[str, float]]) -> np.ndarray:
    """The shift of each line: the least and, if positive, the largest of the elements around it.

    An element that holds all articles of the page (or, without articles, all of ``main``) is no boilerplate, whatever its name; nor is, on a
    page without either, one that holds more than half of the text, unless its very kind says so.
    """
    size, total = [0] * len(shifts), sum(len(x.text) for x in lines)
    for x in lines:
        for e in x.shifted:
            size[e] += len(x.text)
    held = [e for e, n in enumerate(size) if n]
    tops = {e for e in held if shifts[e][0] == "article"} or {e for e in held if shifts[e][0] == "main"}
    around: set[int] | None = None  # elements that hold all lines of these; few of which lie within each other
    for x in lines:
        if not tops.isdisjoint(x.shifted):
            around = set(x.shifted) if around is None else around.intersection(x.shifted)
    around = (around or set()) - tops
    large = {e for e, n in enumerate(size) if not tops and 2 * n > total and shifts[e][0] not in KINDS}
    value = [0.0 if s < 0 and (e in around or e in large) else s for e, (_, s) in enumerate(shifts)]
    return np.array([min([0.0, *(value[e] for e in x.shifted)]) + max([0.0, *(value[e] for e in x.shifted)]) for x in lines])


def grow(evidence: np.ndarray, shift: np.ndarray, at: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Picked lines, and lines of at least LOW next to one that aren't further inside of boilerplate."""
    out = picked.copy()
    for order in (range(1, len(at)), range(len(at) - 2, -1, -1)):
        for i in order:
            j = i - 1 if order.step > 0 else i + 1
            if not out[i] and out[j] and evidence[i] >= LOW and shift[i] >= min(shift[j], 0.0) and abs(at[i] - at[j]) <= 2:
                out[i] = True
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line; empty for null, empty or text-free pages."""
    if not html:
        return ""
    reader = PageReader()
    reader.feed(html)
    reader.close()
    reader.flush()
    lines = reader.lines
    if not lines:
        return ""
    at, shift = places(lines, reader.around, reader.depth), shifts_of(lines, reader.shifts)
    ratio = smooth(np.array([(len(x.text) - min(x.linked, len(x.text))) / (1 + x.tags) for x in lines], float), at)
    evidence = np.log1p(ratio) + shift + HEADING_SHIFT * np.array([x.heading for x in lines])
    threshold = two_clusters(evidence)
    picked = evidence >= min(max(threshold, LOW), HIGH)
    if not picked.any():  # a page of a few words
        picked = (evidence >= threshold) & (evidence > 0)
    picked = grow(evidence, shift, at, picked)
    return "\n\n".join(x.text for x, p in zip(lines, picked, strict=True) if p)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html", 4 << 20):
        texts = [main_text(h) for h in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """Return per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    A null or empty html, or one without an article's text, has the empty text. Repeated rows give repeated
    rows. Nothing is cut, whatever a page's length. Other columns are ignored.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
