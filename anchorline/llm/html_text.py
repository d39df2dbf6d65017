"""Main text of web pages from parser events and smoothed text-to-tag ratios.

A page is read once as a stream of standard-library parser events.  Block elements cut it
into lines; every line has its characters and the tags met in it.  The ratio of the two is
smoothed over neighbouring lines with a Gaussian and clustered by a threshold, so that
runs of lines rich in text stand out from menus and notices.  The content region follows from these runs:

* ``main``, if it holds at least half of their text and every article that has any;
* else the articles and the headings beside them, if they hold nearly all (``NEARLY``);
* else the smallest element that holds all runs.

All its lines are kept, short ones among long ones too, except those inside elements that say what they are: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments.  Outside
articles an element says so by class, id or role; inside one only containers do, by class or role, and only
by words that name no part of an article.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup p "
    "pre section summary table tbody tfoot thead tr ul".split())
DROPPED = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form frame frameset head iframe input "
    "menu nav noframes noscript object option script select style svg template textarea title video".split())
SPACING = frozenset("br hr td th img".split())
#: Words in class, id or role that name a part of a page that is no article.
PARTS = frozenset(
    "ad ads advert advertisement advertisements adverts alert banner breadcrumb breadcrumbs comment commentlist "
    "comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus "
    "footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
    "widget widgets".split())
#: Those of them that may name a part of an article, and the elements that may name any inside one.
OF_ARTICLES = frozenset(
    "alert banner copyright dialog disclaimer discussion form header login menu menubar modal notice notices "
    "notification overlay respond search skip social toolbar".split())
CONTAINERS = frozenset("aside div dl figure footer header nav ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the runs' text that articles hold where what stands beside them is left out.
NEARLY = 0.8
#: Widths in lines of the smoothing.
SIGMA, RADIUS = 1.0, 3
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)


class _Element:
    __slots__ = ("tag", "parent", "dropped", "article")

    def __init__(self, tag, parent, dropped, article):
        self.tag, self.parent, self.dropped, self.article = tag, parent, dropped, article


def _names(attrs, keys=("class", "id", "role")) -> set[str]:
    found: set[str] = set()
    for key, value in attrs:
        if key in keys and value:
            for c in "-_:/.":
                value = value.replace(c, " ")
            found.update(value.lower().split())
    return found


class PageLines(HTMLParser):
    """Lines of a page in order: text, tags met, characters inside links, element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Element("", None, False, False)
        self.lines: list[tuple[str, int, int, _Element]] = []
        self.pieces: list[str] = []
        self.tags = self.linked = self.links = 0

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def flush(self):
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.here))
            self.pieces = []
            self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            self._close_open("p", "div td th article section body")
            if tag == "li":
                self._close_open("li", "ul ol menu dir")
        elif tag in SPACING:
            self.pieces.append(" ")
        if tag in VOID:
            return
        here = self.here
        if tag == "a":
            self.links += 1
        dropped = here.dropped
        if not dropped or tag == "main":
            dropped = self._drops(tag, attrs, here)
        if tag in BLOCK or dropped != here.dropped or tag in DROPPED:
            if dropped != here.dropped:
                self.flush()
            self.here = _Element(tag, here, dropped, here.article or tag in ("article", "main"))

    def _drops(self, tag, attrs, here) -> bool:
        if tag in DROPPED or tag == "header" and not here.article:
            return True
        if tag in ("html", "body", "main"):
            return False
        if here.article:
            if tag in CONTAINERS and _names(attrs, ("class", "role")) & PARTS - OF_ARTICLES:
                return True
        elif (names := _names(attrs)) & PARTS:
            return tag != "article" or bool(names & {"ad", "advert", "comment", "comments", "promo", "related", "reply"})
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if key == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def _close_open(self, tag: str, until: str):
        stop, at = until.split(), self.here
        while at.parent is not None and at.tag not in stop:
            if at.tag == tag:
                self.here = at.parent
                return
            at = at.parent

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("a", "p", "div", "li"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        elif tag in SPACING:
            self.pieces.append(" ")
        if tag in BLOCK:
            self.flush()
        at = self.here
        while at.parent is not None:
            if at.tag == tag:
                self.flush()
                self.here = at.parent
                return
            at = at.parent

    def handle_data(self, data):
        if self.here.dropped:
            return
        self.pieces.append(data)
        if self.links:
            self.linked += len(data)

    def read(self, html: str) -> list[tuple[str, int, int, _Element]]:
        self.feed(html)
        self.close()
        self.flush()
        return self.lines


def rich_lines(chars: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Lines whose smoothed text-to-tag ratio reaches the threshold."""
    ratio = chars / np.maximum(tags, 1)
    weight = np.convolve(np.ones(len(ratio)), _KERNEL)[RADIUS:-RADIUS]
    smooth = np.convolve(ratio, _KERNEL)[RADIUS:-RADIUS] / weight
    return smooth >= min(smooth.std(), smooth.mean())


def _path(element: _Element) -> list[_Element]:
    found = []
    while element is not None:
        found.append(element)
        element = element.parent
    return found


def main_text(html: str | None) -> str:
    """Blocks of the content region in page order, two line ends between them."""
    lines = PageLines().read(html) if html else []
    if not lines:
        return ""
    chars = np.array([len(line[0]) for line in lines], float)
    linked = np.array([line[2] for line in lines], float)
    rich = rich_lines(chars - np.minimum(linked, chars), np.array([line[1] for line in lines], float))
    if not rich.any():
        rich[:] = True
    held: dict[_Element, float] = {}
    depth: dict[_Element, int] = {}
    for line, size, take in zip(lines, chars.tolist(), rich.tolist()):
        if take:
            path = _path(line[3])
            for i, element in enumerate(path):
                held[element] = held.get(element, 0.0) + size
                depth[element] = len(path) - i
    total = float(chars[rich].sum())
    paths = [_path(line[3]) for line in lines]
    outside = [(path, size) for path, size, take in zip(paths, chars.tolist(), rich.tolist()) if take]
    mains = [e for e in held if e.tag == "main" and 2 * held[e] >= total
             and not any(e not in path and any(x.tag == "article" for x in path) for path, _ in outside)]
    articles = {e for e in held if e.tag == "article" and not any(x.tag == "article" for x in _path(e)[1:])}
    if mains:
        region = min(mains, key=lambda e: depth[e])
        inside = [region in path for path in paths]
    elif articles and sum(held[e] for e in articles) >= NEARLY * total:
        inside = [line[3].tag in HEADINGS or any(e in articles for e in path) for line, path in zip(lines, paths)]
    else:
        whole = [e for e in held if held[e] == total and e.tag not in ("p", "b", "li")]
        region = max(whole, key=lambda e: depth[e])
        # nothing says where the whole ends: leave out lists of links beside the articles
        inside = [region in path and (line[3].article or x < 0.6 * n)
                  for path, line, x, n in zip(paths, lines, linked.tolist(), chars.tolist())]
    return "\n\n".join(line[0] for line, take in zip(lines, inside) if take)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.large_string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block becomes one space,
    blocks are trimmed and joined in page order by two line ends; nothing is shortened.
    Null and empty pages and pages without text give the empty text.  Broken markup is
    read as far as the parser can.  Repeated rows and null ids are read row by row; an
    empty table gives no rows; other columns are not read.
    """
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
