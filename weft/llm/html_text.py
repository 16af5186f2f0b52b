"""Main text of web pages: parser events make lines, their text-to-tag ratio is smoothed and clustered, and the article that holds the dense lines is kept, or the page where none does."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import pick

# Names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NEVER = frozenset("script style noscript template iframe object svg math canvas audio video head title button select textarea datalist option dialog input label fieldset menu".split())
FURNITURE = frozenset("nav footer aside form header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An opening tag of the key ends an open element of the values, unless a tag of the third group lies between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table select div section article main body".split())
#: Words of class and id names.
AWAY = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr login menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "teaser toolbar topbar tracking widget".split()
)
AWAY_OUTSIDE = frozenset("footer header masthead bottom top".split())

#: Characters of a paragraph that is running text.
RUNNING = 60

_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    away: bool  # its text isn't the page's main text
    inside: bool  # of an article or main element
    heading_only: bool = False
    titled: bool = False  # it's a heading, or within one, of an element of which headings alone count

    def __post_init__(self):
        self.box: Element = self if self.tag in BLOCKS or not self.parent else self.parent.box  # the block that it stands in


@dataclass
class Line:
    element: Element
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Lines(HTMLParser):
    """Lines of text in page order, each with the element that holds it and the number of tags met since the one before."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = Element("", None, False, False)
        self.lines: list[Line] = []
        self.now = Line(self.at)
        self.in_link = 0
        self.open: Counter = Counter()  # open elements by tag

    def _break(self) -> None:
        if any(not p.isspace() for p in self.now.parts):
            self.lines.append(self.now)
            self.now = Line(self.at)
        else:
            self.now.parts.clear()
            self.now.element, self.now.linked = self.at, 0

    def _judge(self, tag: str, attrs: list[tuple[str, str | None]]) -> Element:
        a, up = {k: v or "" for k, v in attrs}, self.at
        names = set(_NAME.findall(_CAMEL.sub(" ", f"{a.get('class', '')} {a.get('id', '')}").lower()))
        role = a.get("role", "").lower()
        hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        e = Element(tag, up, up.away, up.inside, up.heading_only)
        marked = bool(names & AWAY) and tag not in ("body", "html")
        if tag in ("article", "main") or role in ("main", "article"):
            # The article may stand in a form or header that wraps the page or was never closed.
            wrapped = up
            while wrapped and wrapped.away and wrapped.tag in FURNITURE | {""} and not wrapped.inside:
                wrapped = wrapped.parent
            e.away = marked or hidden or bool(wrapped and wrapped.away)
            e.inside, e.heading_only = True, False
            return e
        if tag in NEVER or hidden or marked or role in ROLES:
            e.away = True
        elif tag in FURNITURE or names & AWAY_OUTSIDE and tag not in HEADINGS and tag not in ("body", "html"):
            if up.inside and not up.away and (tag == "header" or "header" in names):
                e.heading_only = True
            elif tag in FURNITURE or not up.inside:
                e.away = True
        e.titled = e.heading_only and (up.titled or tag in HEADINGS)
        return e

    def _leave(self, to: Element) -> None:
        """Closes what is open within ``to``."""
        while self.at is not to:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        self.now.tags += 1
        if tag in VOID:
            if tag == "hr":
                self._break()
            elif tag == "br":
                self.now.parts.append(" ")
            return
        if tag in BLOCKS:
            self._break()
            e = self.at
            if tag not in ("li", "td", "th", "dd", "dt", "tr", "option") or tag in ENDS:
                self._close_implied(tag, e)
        self.at = self._judge(tag, attrs)
        self.open[tag] += 1
        if tag in BLOCKS:
            self.now.element = self.at
        self.in_link += tag == "a"

    def _close_implied(self, tag: str, e: Element | None) -> None:
        # A block ends an open paragraph; items and cells end those before them.
        ends = [x for x in (*ENDS.get(tag, ()), "p") if self.open[x]]
        if not ends:
            return
        to = self.at
        while e and e.tag not in HOLDS and e.parent:
            if e.tag in ends:
                to = e.parent
            e = e.parent
        self._leave(to)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "g", "use", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.now.tags += 1
        if tag in VOID:
            return
        if tag in BLOCKS:
            self._break()
        e = self.at if self.open[tag] else None
        while e and e.tag != tag:
            # A stray end tag of a small element doesn't end the boxes around it.
            if e.tag in HOLDS and tag not in HOLDS | FURNITURE | {"html"}:
                return
            e = e.parent
        if e and e.parent:
            self._leave(e.parent)
            if tag in BLOCKS:
                self.now.element = self.at
        self.in_link = max(0, self.in_link - (tag == "a"))

    def handle_data(self, data):
        # Text straight within a line keeps the line's element; what stands in an element to be left out is left out.
        if self.at.away or self.at.heading_only and not self.at.titled:
            return
        if not self.now.parts:
            self.now.element = self.at.box
        self.now.parts.append(data)
        if self.in_link:
            self.now.linked += len(data)

    def close(self):
        super().close()
        self._break()


def smoothed(ratio: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the ends repeat their line."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """The border between the two clusters of one-dimensional 2-means; -inf if all values are about equal."""
    lo, hi = float(values.min()), float(values.max())
    if hi - lo <= 1e-9 * max(1.0, abs(hi)):
        return -math.inf
    for _ in range(50):
        cut = (lo + hi) / 2
        below, above = values[values <= cut], values[values > cut]
        new = (float(below.mean()), float(above.mean()))
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def main_text(html: str | None, sigma: float = 1.5) -> str:
    """The main text of a page, blocks joined by line ends; empty for null, empty or textless pages.

    Article or main elements that hold a quarter of the dense lines' text or more are the region; else the whole page is, as no
    share of the text tells where plain lines end that count. All lines of the region count that stand in no menu, advert, form or the like.
    """
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    texts = [x.text for x in lines]
    length = np.array([len(t) for t in texts], dtype=float)
    linked = np.array([x.linked for x in lines], dtype=float)
    ratio = np.maximum(length - linked, 0) / np.maximum(1.0, [x.tags for x in lines])
    dense = smoothed(ratio, sigma)
    dense = (dense > threshold(dense)) * length
    total = float(dense.sum())
    inside = [x.element.inside for x in lines]
    if any(inside) and sum(d for d, i in zip(dense, inside, strict=True) if i) >= 0.25 * total:
        chosen = inside
    else:
        chosen = [True] * len(lines)
    # Lines that are links alone are menus whatever their element is, but for paragraphs within running text: beside one of the same box that isn't.
    plain = linked < 0.9 * length
    beside = lambda k, n: 0 <= n < len(lines) and plain[n] and length[n] >= RUNNING and lines[n].element.tag == "p" and lines[n].element.parent is lines[k].element.parent
    running = lambda k: lines[k].element.tag == "p" and (beside(k, k - 1) or beside(k, k + 1))
    return "\n".join(t for k, t in enumerate(texts) if chosen[k] and (lines[k].element.inside or plain[k] or running(k)))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages(page_id, url, html).

    Null and empty html give the empty text; repeated rows are extracted each; columns beside these aren't read.
    Rows don't depend on each other: no shuffle, and memory for one page at a time.
    """
    pages = pick(pages, "page_id", "url", "html")
    kinds = [f"{n} {pages.schema[n].dataType.simpleString()}" for n in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "url": b.column(1), "text": pa.array(texts, type=pa.string()), "n_chars": pa.array(map(len, texts), type=pa.int64())})

    return pages.mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars long")
