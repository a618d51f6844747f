"""Periods, quarters and lenient date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"
OPEN_START = "0001-01-01"


def valid_at(day: Column, start: Column, end: Column) -> Column:
    """Both ends inclusive; a NULL end is open. A NULL start is never valid."""
    return (day >= start) & (end.isNull() | (day <= end))


def active_at(day: Column, start: Column, end: Column) -> Column:
    """As `valid_at`, with a NULL start open as well."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (day <= end))


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter")


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-T"), F.quarter(day).cast("string"))


def mid_quarter(quarter: Column) -> Column:
    """Day on which a role is read for a whole quarter: the 15th of its middle month."""
    return F.date_add(F.add_months(quarter, 1), 14)


# Month names used in published dates.
MONTHS = (
    "gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre",
    "novembre", "dicembre",
)


def date_in_words(day: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.concat_ws(" ", F.day(day).cast("string"), F.element_at(names, F.month(day)), F.year(day).cast("string"))


def as_of_words(day: Column) -> Column:
    """With the article: the 8th and the 11th start with a vowel."""
    article = F.when(F.day(day).isin(8, 11), "all'").otherwise("al ")
    return F.concat(article, date_in_words(day))


def compact_date(text: Column) -> Column:
    """yyyymmdd, NULL when it is anything else (callers turn NULL into a violation)."""
    return F.when(text.rlike("^[0-9]{8}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def iso_prefix_date(text: Column) -> Column:
    head = F.substring(text, 1, 10)
    return F.when(head.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.to_date(F.try_to_timestamp(head, F.lit("yyyy-MM-dd"))))


# The timestamp shapes found in feeds, sitemaps and search answers.
INSTANT_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss zzz", "yyyyMMdd'T'HHmmssXXX",
)


def instant(text: Column) -> Column:
    """First shape that parses; a text without a zone is read in the session zone, which callers pin to UTC."""
    trimmed = F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", "")
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in INSTANT_FORMATS])
