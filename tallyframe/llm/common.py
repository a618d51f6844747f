"""What the operators share: texts as columns, names that clash with nothing, numbering without one large window."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import let
from tallyframe.storage import written

__all__ = ["SPACE", "folded", "free_name", "let", "offsets", "raw_words", "small_batches", "total", "written"]

SPACE = r"[\x20\x09-\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; a NULL is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() alone would change letters beyond A-Z; a text without those takes the fast way to the same result
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def raw_words(text: Column) -> Column:
    """The runs of characters other than blanks (0x20, 0x09 to 0x0D), in order; none for NULL."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE + "+")))


def free_name(df: DataFrame, base: str) -> str:
    """`base`, lengthened until no column of the frame has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def offsets(sums: DataFrame, group: str, bucket: str, value: str, alias: str) -> DataFrame:
    """For each (group, bucket) the sum of `value` over the buckets before it. `sums` has one row per bucket, not per row."""
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(group, bucket, F.coalesce(F.sum(value).over(before), F.lit(0).cast("bigint")).alias(alias))


def total(df: DataFrame, *columns: Column):
    """One row of aggregates of the whole frame."""
    return df.agg(*columns).first()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it lasts, Python is sent so many rows at a time: rows that hold whole texts are too large for the usual number,
    which both sides keep in memory at once. The session's own setting is put back afterwards."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)
