"""What is published: questions, subjects, corrections, and the sections of a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import json_in_words
from tallyframe.operators.temporal import newest


def active_questions(statements: DataFrame) -> DataFrame:
    """Id, text, theme, origin day and chamber of the active statements, with their context where they have one; drafts and
    withdrawn ones are left out."""
    return statements.filter(F.col("status") == "active").select(
        F.col("statement_id").alias("id"), "text", "theme", F.col("origin.date").alias("date"),
        F.col("origin.chamber").alias("chamber"), *[c for c in statements.columns if c == "context"],
    )


def corrections(rows: DataFrame) -> DataFrame:
    """Published corrections in words, with their place from the newest."""
    return rows.select(
        F.to_date("published_at").alias("day"), F.concat_ws(":", "object_kind", "object_id").alias("object"),
        json_in_words(F.col("before")).alias("before"), json_in_words(F.col("after")).alias("after"), "reason",
    )


def ballot_title(act_title: Column, description: Column, title: Column, ref: Column) -> Column:
    return F.coalesce(act_title, description, title, ref, F.lit(""))


def alphabetical(df: DataFrame, name: str, *then: str) -> DataFrame:
    """Order of names in the language of the publication, accents and case as readers expect them."""
    return df.orderBy(F.collate(F.col(name), "it"), *then)


def themed_share(metrics: DataFrame, themes: list[str]) -> DataFrame:
    """(party_id, document_id, themed, promises, scale): promises with a theme of all promises, and the largest theme."""
    counts = [F.col(t) for t in themes]
    return metrics.select(
        "party_id", "document_id", sum(counts[1:], counts[0]).alias("themed"), "promises", F.greatest(*counts).alias("scale")
    )


def rotated(items: DataFrame, keys: list[str], item: str, seed: str) -> DataFrame:
    """Adds `place`: an order of the items of each group that looks random and is the same for the same seed."""
    from pyspark.sql import Window

    mixed = F.xxhash64(F.lit(seed), *keys, item)
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(mixed, item)))


def samples_of_rejected(rejected: DataFrame, key: str, order: list[Column], per_key: int = 3) -> DataFrame:
    """The first few rejected rows per document: shown in the report, while all of them are counted."""
    return newest(rejected, [key], order, rank=per_key)


def flagged_done(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Adds `done`: the item has an entry, however many."""
    known = done.select(key).distinct().withColumn("_d", F.lit(True))
    return items.join(known, key, "left").withColumn("done", F.col("_d").isNotNull()).drop("_d")


def of_party(documents: DataFrame, programmes: DataFrame, party: str | None) -> DataFrame:
    """Documents of one party, or all of them when no party is named."""
    if party is None:
        return documents
    mine = programmes.filter(F.col("party_id") == party).select("document_id").distinct()
    return documents.join(mine, "document_id", "left_semi")


def with_optional_parts(base: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Left joins of (key, value) tables by name: a ballot keeps its row whichever of its parts are missing."""
    out = base
    for name, part in parts.items():
        out = out.join(part.select(key, F.col("value").alias(name)), key, "left")
    return out


def first_samples(rejected: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """The first few rejected rows of all, for the head of a report; each task hands on so many at most."""
    return rejected.orderBy(*order).limit(n)
