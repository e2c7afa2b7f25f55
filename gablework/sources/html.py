"""Pages of HTML: main text, title and links, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

#: Elements without content of a page, and those that make its blocks.
DROPPED = frozenset("script style nav header footer aside noscript svg form".split())
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li td th blockquote pre".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.links: list[str] = []
        self.title = ""
        self.skip, self.in_title = 0, False
        self.open: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            href = dict(attrs).get("href")
            if href:
                self.links.append(href)
        elif tag == "br" and self.open:
            self.open[-1][1].append(" ")
        if tag in BLOCKS and not self.skip:
            if self.open and tag not in ("li", "td", "th"):
                self.open.append(("", self.open[-1][1]))  # inside another block: part of it
            else:
                self._close()
                self.open.append((tag, []))

    def _close(self) -> None:
        while self.open:
            tag, parts = self.open.pop()
            if tag:
                text = re.sub(r"[ \t\r\f\v\n]+", " ", "".join(parts)).strip()
                if text:
                    self.blocks.append(text)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in BLOCKS and self.open:
            if self.open[-1][0] == "":
                self.open.pop()
            else:
                self._close()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif self.open and not self.skip:
            self.open[-1][1].append(data)


def read_html(html: str) -> tuple[str, str, list[str]]:
    """Title, text (distinct blocks apart by blank lines) and links."""
    r = _Reader()
    r.feed(html)
    r.close()
    r._close()
    return " ".join(r.title.split()), "\n\n".join(dict.fromkeys(r.blocks)), r.links


def extract(pages: DataFrame) -> DataFrame:
    """(url, title, text, links) of pages (url, html); a missing title is the url. Links are absolute; a null page is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                title, text, links = read_html(html or "")
                good = []
                for x in links:
                    try:
                        good.append(urljoin(url or "", x))
                    except ValueError:
                        continue
                rows.append((url, title or url, text, good))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["url", "title", "text", "links"])

    return pages.select("url", "html").mapInArrow(run, "url string, title string, text string, links array<string>")


def discovered(extracted: DataFrame, *, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(url, link): canonical links of a page to pages of its own host, no files, by patterns, each once."""
    rows = extracted.select("url", F.explode("links").alias("link")).filter(F.col("link").rlike("(?i)^https?://"))
    rows = rows.filter((U.host_key(F.col("link")) == U.host_key(F.col("url"))) & ~U.is_file(F.col("link"))).select("url", U.canonical(F.col("link")).alias("link"))
    if include:
        rows = rows.filter(F.col("link").rlike(include))
    if exclude:
        rows = rows.filter(~F.col("link").rlike(exclude))
    return rows.distinct()


def crawl_order(links: DataFrame, starts: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(url, hops): pages reachable from the start pages (url), with the fewest hops; one join a hop, each cut from the plan before it.

    All start pages are crawled at once, until no page is new or most_hops are gone.
    """
    from ..session import cut

    links = cut(links)
    seen = front = cut(starts.select("url").distinct().withColumn("hops", F.lit(0)))
    hop = 0
    while most_hops is None or hop < most_hops:
        hop += 1
        nxt = links.join(front.select("url"), "url").select(F.col("link").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        front = cut(nxt.withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen
