"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, a clustering threshold.

Scale: no shuffle. A page is parsed as a stream of events of the standard library's parser, without a tree; what is held
of it is its lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm._text import batches

EXTRACTED = "page_id long, url string, title string, content string, n_lines int, kept_lines int, threshold double"
#: Elements whose text nobody reads.
HIDDEN = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "head", "title"))
#: What may stand in a head; any other element, and bare text, ends it.
IN_HEAD = frozenset(("html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template"))
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre "
    "section table td th tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class HtmlParams:
    """sigma: of the Gaussian, in lines. radius: lines that it reaches on either side. contrast: how many times the mean
    of the lower cluster that of the upper must be; below, all lines are content."""

    sigma: float = 1.0
    radius: int = 3
    contrast: float = 2.0


class LineReader(HTMLParser):
    """Collects (text, tags) by line; a line ends at a line feed of the source and at a block element's edge.

    ``open_tags``: start tags, by number, of hidden elements that were never closed; a reader that is told to ``ignore``
    them reads what follows them. Script and style elements, and a head, are not among them.
    """

    def __init__(self, ignore: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.title: str | None = None
        self.open_tags: frozenset[int] = frozenset()
        self._ignore = ignore
        self._number = 0
        self._parts: list[str] = []
        self._tags = 0
        self._hidden: list[tuple[str, int]] = []

    def _end_line(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text or self._tags:
            self.lines.append((text, self._tags))
        self._parts, self._tags = [], 0

    def _visible(self, tag: str) -> bool:
        """Whether a start tag stands in the open, perhaps because it ends a head."""
        if self._hidden and tag == "body":  # whatever was not closed
            self._hidden.clear()
        elif tag not in IN_HEAD:
            self._end_head()
        return not self._hidden

    def _end_head(self) -> None:
        while self._hidden and self._hidden[-1][0] == "head":
            self._hidden.pop()

    def _hides(self, tag: str) -> bool:
        return tag in HIDDEN and self._number not in self._ignore

    def set_cdata_mode(self, elem: str, **more) -> None:
        if elem in ("script", "style") or self._number not in self._ignore:
            super().set_cdata_mode(elem, **more)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._number += 1
        if self._visible(tag):
            if tag in BLOCKS:
                self._end_line()
            self._tags += 1
        if self._hides(tag):
            self._hidden.append((tag, self._number))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if self._visible(tag):
            if tag in BLOCKS:
                self._end_line()
            self._tags += 1

    def handle_endtag(self, tag: str) -> None:
        if self._hidden:
            if any(tag == t for t, _ in self._hidden):
                while self._hidden.pop()[0] != tag:
                    pass
            return
        if tag not in VOID:
            self._tags += 1
        if tag in BLOCKS:
            self._end_line()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if self._hidden:
            within = [tag for tag, _ in self._hidden if tag != "head"]
            if within == ["title"]:
                self.title = (self.title or "") + data
            return
        first, *more = data.split("\n")
        self._parts.append(first)
        for piece in more:
            self._end_line()
            self._parts.append(piece)

    def finish(self) -> None:
        self.close()
        self._end_line()
        self.open_tags = frozenset(number for tag, number in self._hidden if tag not in ("script", "style", "head"))


def read(html: str) -> LineReader:
    """The reader after a page. Elements that hide text hide none if they are never closed."""
    ignore: frozenset[int] = frozenset()
    while True:
        reader = LineReader(ignore)
        reader.feed(html)
        reader.finish()
        if not reader.open_tags:
            return reader
        ignore |= reader.open_tags


def smooth(ratio: np.ndarray, p: HtmlParams) -> np.ndarray:
    """Gaussian mean of each line and its neighbours; beyond the ends there is nothing to weigh."""
    near = np.exp(-0.5 * (np.arange(-p.radius, p.radius + 1) / p.sigma) ** 2)
    return np.convolve(ratio, near)[p.radius : p.radius + len(ratio)] / np.convolve(np.ones(len(ratio)), near)[p.radius : p.radius + len(ratio)]


def cluster_threshold(values: np.ndarray) -> tuple[float, float, float]:
    """(threshold, mean below, mean above) of the split of a line of values with the least variance inside its parts."""
    x = np.sort(values)
    n = len(x)
    if n < 2 or x[0] == x[-1]:
        return float(x[0]) if n else 0.0, float(x[0]) if n else 0.0, float(x[-1]) if n else 0.0
    total = np.cumsum(x)
    k = np.arange(1, n)
    low, high = total[:-1] / k, (total[-1] - total[:-1]) / (n - k)
    gain = k * (n - k) * (high - low) ** 2
    gain[x[1:] == x[:-1]] = -1  # equal values stay together
    at = int(gain.argmax())
    return float(x[at + 1]), float(low[at]), float(high[at])


def extract(html: str, p: HtmlParams = HtmlParams()) -> tuple[str, str, int, int, float]:
    """(title, content, lines, kept lines, threshold) of one page."""
    reader = read(html)
    title = " ".join((reader.title or "").split())
    lines = reader.lines
    if not lines:
        return title, "", 0, 0, 0.0
    ratio = np.array([len(text) / max(1, tags) for text, tags in lines])
    level = np.log1p(smooth(ratio, p))
    threshold, low, high = cluster_threshold(level)
    if np.expm1(high) < p.contrast * np.expm1(low):
        keep = np.ones(len(lines), dtype=bool)
        threshold = 0.0
    else:
        keep = level >= threshold
    kept = [text for (text, _), k in zip(lines, keep) if k and text]
    return title, "\n".join(kept), sum(1 for text, _ in lines if text), len(kept), float(np.expm1(threshold))


def _extract(p: HtmlParams):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches(parts):
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                none = (None,) * 5
                rows = [extract(x.as_py(), p) if x.is_valid else none for x in batch["html"]]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch["page_id"], batch["url"], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                    names=["page_id", "url", "title", "content", "n_lines", "kept_lines", "threshold"],
                )

    return run


def extract_pages(pages: DataFrame, p: HtmlParams = HtmlParams()) -> DataFrame:
    """(page_id, url, title, content, n_lines, kept_lines, threshold) of every row of ``pages``.

    content: the lines whose smoothed text-to-tag ratio is in the upper of two clusters, joined by line feeds; all lines
    where the clusters hardly differ. threshold: the least ratio kept. A null html gives nulls, an empty one or one without
    text an empty content. A head ends, closed or not, where an element or text follows that can't be in it; an element
    that hides its text (a form's choices, say) hides none if it is never closed. What follows an unclosed script or style
    element is its text, as in browsers. A page with text in the open has a content. Very long pages are read whole;
    repeated rows each give a row. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(p), EXTRACTED)
