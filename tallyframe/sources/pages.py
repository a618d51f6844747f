"""Links, main text and reservation signals of landed web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyframe.functions import text as X
from tallyframe.functions import urls as U
from tallyframe.operators.temporal import newest

HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def listing_links(pages: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, pos, link): normalised absolute addresses that match, first occurrence per page, in page order."""
    found = pages.select(
        key, "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "_href")
    )
    normal = found.select(key, "pos", U.normal_url(U.resolve(F.col("url"), F.col("_href"))).alias("link"))
    kept = normal.filter(F.col("link").rlike(pattern))
    return kept.groupBy(key, "link").agg(F.min("pos").alias("pos"))


def sitemap_links(sitemaps: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, pos, link, published_at, rank) of the urlset documents in column `xml`, matching addresses only. An entry keeps its
    own date, whichever entries have none; rank 1 is the newest of the document, undated entries are last, in their order."""
    from tallyframe.functions.dates import instant

    entries = F.from_xml("xml", "url array<struct<loc: string, lastmod: string>>", {"ignoreNamespace": "true"})["url"]
    rows = sitemaps.select(key, F.posexplode(entries).alias("pos", "_e"))
    dated = rows.filter(F.trim("_e.loc").rlike(pattern)).select(
        key, "pos", U.normal_url(F.trim("_e.loc")).alias("link"), instant(F.col("_e.lastmod")).alias("published_at")
    )
    newest_first = Window.partitionBy(key).orderBy(F.col("published_at").desc_nulls_last(), "pos")
    return dated.withColumn("rank", F.row_number().over(newest_first))


def sitemap_children(indexes: DataFrame, key: str, contains: str) -> DataFrame:
    """(key, link) of the child sitemaps whose address contains the text."""
    locs = F.expr("xpath(xml, \"/*[local-name()='sitemapindex']/*[local-name()='sitemap']/*[local-name()='loc']/text()\")")
    rows = indexes.select(key, F.explode(locs).alias("link"))
    return rows.select(key, F.trim("link").alias("link")).filter(F.contains("link", F.lit(contains)))


# Elements whose content is never text, and elements that hold the main text when a page has them.
SKIPPED = {"script", "style", "template", "noscript", "nav", "header", "footer", "aside", "form", "svg", "head"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "tr", "blockquote", "pre", "br"}
HIDDEN_STYLE = re.compile(r"display:none|visibility:hidden")


class _Visible(HTMLParser):
    """Visible text of a page; hidden elements are left out whole, as are their children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []
        self.title: list[str] = []
        self.heading: list[str] = []  # of the article
        self.main: list[str] = []
        self.rest: list[str] = []
        self.date: str | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "") for k, v in attrs}
        if tag == "meta" and a.get("property", a.get("name", "")) in ("article:published_time", "date"):
            self.date = self.date or a.get("content")
        if tag == "time" and not self.date:
            self.date = a.get("datetime")
        if tag in BLOCKS:
            self._put("\n")
        if tag in VOID:
            return
        hidden = (
            "hidden" in a or a.get("aria-hidden") == "true"
            or bool(HIDDEN_STYLE.search(a.get("style", "").replace(" ", "")))
        ) and tag not in ("html", "body")
        above = self.stack[-1] if self.stack else ("", False, False)
        self.stack.append((tag, above[1] or hidden or tag in SKIPPED, above[2] or tag in MAIN))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        if tag in BLOCKS:
            self._put("\n")

    def handle_data(self, data):
        tags = [tag for tag, _, _ in self.stack]
        if tags[-1:] == ["title"] and "svg" not in tags:
            self.title.append(data)
        elif "h1" in tags and any(main for _, _, main in self.stack) and not self.stack[-1][1]:
            self.heading.append(data)
        self._put(data)

    def _put(self, data):
        _, skipped, main = self.stack[-1] if self.stack else ("", False, False)
        if not skipped:
            (self.main if main else self.rest).append(data)


def _read(html: str | None) -> tuple[str | None, str | None, str | None]:
    if not html:
        return None, None, None
    parser = _Visible()
    parser.feed(html)
    parser.close()
    body = "".join(parser.main)
    return "".join(parser.heading if "".join(parser.heading).strip() else parser.title), body if body.strip() else "".join(parser.rest), parser.date


PAGES_AT_ONCE = 100  # pages a task holds as Python strings at a time


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_AT_ONCE):
            piece = batch.slice(at, PAGES_AT_ONCE)
            parts = zip(*[_read(h.as_py()) for h in piece.column("html")], strict=True)
            read = [pa.array(p, pa.string()) for p in parts]
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("reserved"), *read], ["page_id", "reserved", "title", "text", "date"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, title, text, date, reserved) of (page_id, url, html).

    Parsing a page needs a parser, so it runs in Arrow batches, a few pages at a time; cleaning the result stays in the JVM.
    """
    flagged = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html", X.reserves_rights(F.col("html")).alias("reserved"))
    rows = flagged.mapInArrow(_read_pages, "page_id bigint, reserved boolean, title string, text string, date string")
    empty = F.lit("")
    return rows.select(
        "page_id", F.nullif(X.clean_text(F.col("title")), empty).alias("title"),
        F.nullif(X.clean_text(F.col("text")), empty).alias("text"), "date", "reserved",
    )


@F.pandas_udf(StringType())
def _decoded(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    def one(body, charset):
        if body is None:
            return None
        try:
            return bytes(body).decode(charset, "replace")
        except LookupError:  # a charset nobody knows
            try:
                return bytes(body).decode("utf-8")
            except UnicodeDecodeError:
                return bytes(body).decode("cp1252", "replace")

    return pd.Series([one(b, c) for b, c in zip(bodies, charsets, strict=True)], dtype=object)


def decode(body: Column) -> Column:
    """Bytes of a page to text: the charset it declares, else UTF-8 when valid, else Windows-1252.

    Valid UTF-8, which nearly every page is, is decoded in the JVM; only the other bodies go through Python.
    """
    page = F.decode(body, "ISO-8859-1")
    head = F.substring_index(F.lower(page), "</head", 1)
    declared = F.regexp_extract(head, "<meta[^>]+charset=[\"']?([a-z0-9_-]+)", 1)
    plain = F.coalesce(F.is_valid_utf8(body.cast("string")), F.lit(False)) & declared.isin("", "utf-8", "utf8")
    charset = F.when(declared == "", "cp1252").otherwise(declared)
    other = _decoded(F.when(~plain, body), charset)
    return F.when(plain, body.cast("string")).otherwise(other)


def path_reservation(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, reserved): the first path rule of the page's host that matches decides; no rule means not reserved.

    rules: host, ord, location (glob), reservation.
    """
    placed = pages.select("page_id", U.host(F.col("url")).alias("host"), U.part(F.col("url"), 3).alias("_p"))
    path = F.when(F.col("_p") == "", "/").otherwise(F.col("_p"))
    matched = placed.join(rules, "host").filter(F.regexp_like(path, U.glob_pattern(F.col("location"))))
    first = newest(matched, ["page_id"], [F.col("ord")]).select(
        "page_id", (F.trim("reservation") == "1").alias("_r")
    )
    return placed.select("page_id").join(first, "page_id", "left").select(
        "page_id", F.coalesce("_r", F.lit(False)).alias("reserved")
    )
