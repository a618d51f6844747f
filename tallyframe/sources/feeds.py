"""Landed feeds, channel previews and article-search answers to elements.

An element: source, ord, url, title, summary, text, published_at, domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.functions import text as X
from tallyframe.functions import urls as U
from tallyframe.functions.dates import instant

_ITEM = "array<struct<title: string, link: string, pubDate: string, date: string, updated: string, description: string, encoded: string>>"
_ENTRY = (
    "array<struct<title: string, link: array<struct<_href: string, _rel: string>>, published: string, updated: string, "
    "summary: string, content: string>>"
)
# Items stand in the channel (RSS 2), beside it (RSS 1), or are the entries of an Atom feed.
FEED = f"channel struct<title: string, item: {_ITEM}>, item {_ITEM}, entry {_ENTRY}, title string"


def _plain(fragment: Column) -> Column:
    """Text of an html fragment."""
    return X.clean_text(X.unescape(F.regexp_replace(F.coalesce(fragment, F.lit("")), "<[^>]+>", "")))


def _feed(xml: Column) -> Column:
    return F.from_xml(xml, FEED, {"ignoreNamespace": "true"})


def feed_elements(feeds: DataFrame) -> DataFrame:
    """Elements of RSS 2, RSS 1 and Atom documents in column `xml`; items without a link are left out.

    The summary is the longer of full content and description. An Atom entry's link is its alternate one, else the first.
    """
    parsed = feeds.select("source", _feed(F.col("xml")).alias("_f"))

    def item(i: Column) -> Column:
        return F.struct(
            i["title"].alias("title"), i["link"].alias("link"), F.coalesce(i["pubDate"], i["date"], i["updated"]).alias("day"),
            i["description"].alias("short"), i["encoded"].alias("full"),
        )

    def entry(e: Column) -> Column:
        main = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        return F.struct(
            e["title"].alias("title"), F.coalesce(F.get(main, F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"]).alias("link"),
            F.coalesce(e["published"], e["updated"]).alias("day"), e["summary"].alias("short"), e["content"].alias("full"),
        )

    found = F.coalesce(
        F.transform("_f.channel.item", item), F.transform("_f.item", item), F.transform("_f.entry", entry)
    )
    items = parsed.select("source", F.posexplode(found).alias("ord", "_i"))
    full, short = _plain(F.col("_i.full")), _plain(F.col("_i.short"))
    return items.filter(F.trim(F.coalesce("_i.link", F.lit(""))) != "").select(
        "source", "ord", U.normal_url(F.trim("_i.link")).alias("url"),
        F.nullif(_plain(F.col("_i.title")), F.lit("")).alias("title"),
        F.nullif(F.when(F.length(short) > F.length(full), short).otherwise(full), F.lit("")).alias("summary"),
        F.lit(None).cast("string").alias("text"), instant(F.col("_i.day")).alias("published_at"),
        F.lit(None).cast("string").alias("domain"),
    )


def feed_errors(feeds: DataFrame) -> DataFrame:
    """(source, error) of the documents that are no feed: no channel, item, entry or title can be read."""
    f = _feed(F.col("xml"))
    bad = F.coalesce(f["channel"].isNull() & f["item"].isNull() & f["entry"].isNull() & f["title"].isNull(), F.lit(True))
    return feeds.filter(bad).select("source", F.lit("unreadable feed").alias("error"))


def channel_elements(pages: DataFrame, message_class: str, text_class: str, address: str) -> DataFrame:
    """Messages of a channel preview page in column `html`, newest first: text only, line breaks kept.

    The title is the first line. A page lists messages from old to new.
    """
    start = rf'(?is)(?=<div[^>]*class="[^"]*{message_class} [^"]*"[^>]*data-post=)'
    pieces = F.filter(F.split("html", start), lambda p: p.rlike("(?is)^<div[^>]*data-post="))
    rows = pages.select("source", F.size(pieces).alias("_n"), F.posexplode(pieces).alias("_pos", "_piece"))
    body = F.regexp_extract("_piece", rf'(?is)<div[^>]*class="[^"]*{text_class}[^"]*"[^>]*>(.*?)</div>', 1)
    text = _plain(F.regexp_replace(body, r"(?i)<br\s*/?>", "\n"))
    post = F.regexp_extract("_piece", '(?is)data-post="([^"]+)"', 1)
    moment = F.regexp_extract("_piece", '(?is)<time[^>]*datetime="([^"]+)"', 1)
    made = rows.select(
        "source", (F.col("_n") - 1 - F.col("_pos")).alias("ord"), F.concat(F.lit(address), post).alias("url"),
        F.lit(None).cast("string").alias("summary"), text.alias("text"), instant(moment).alias("published_at"),
        F.lit(None).cast("string").alias("domain"),
    )
    title = F.get(F.split("text", "\n"), F.lit(0))
    return made.filter(F.col("text") != "").select(
        "source", "ord", "url", title.alias("title"), "summary", "text", "published_at", "domain"
    )


def article_elements(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements of article-search answers in column `body`, and (source, error) of the answers that are not JSON."""
    parsed = answers.withColumn("_a", F.from_json("body", schemas.ARTICLES))
    valid = F.coalesce(F.trim("body").startswith("{") & F.expr("try_parse_json(body) IS NOT NULL"), F.lit(False))
    errors = answers.filter(~valid & (F.trim(F.coalesce("body", F.lit(""))) != "")).select(
        "source", F.trim("body").alias("error")
    )
    rows = parsed.filter(valid).select("source", F.posexplode("_a.articles").alias("ord", "_e"))
    elements = rows.filter(F.coalesce("_e.url", F.lit("")) != "").select(
        "source", "ord", U.normal_url(F.col("_e.url")).alias("url"),
        F.nullif(X.clean_text(F.col("_e.title")), F.lit("")).alias("title"), F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("text"), instant(F.col("_e.seendate")).alias("published_at"),
        F.col("_e.domain").alias("domain"),
    )
    return elements, errors
