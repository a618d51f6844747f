"""Query answers in bindings form, and profiles of a landed source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schemas


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    """(row: map<string,string>) of landed answer files; a missing variable is absent from the map."""
    answers = spark.read.schema(schemas.BINDINGS).json(path, multiLine=True)
    return binding_rows(answers)


def binding_rows(answers: DataFrame, *keep: str) -> DataFrame:
    flat = answers.select(*keep, F.explode("results.bindings").alias("_b"))
    return flat.select(*keep, F.transform_values("_b", lambda _, v: v["value"]).alias("row"))


def bindings_of(json_text: Column) -> Column:
    """Bindings of an answer held in a text column; NULL when it is not such an answer."""
    return F.from_json(json_text, schemas.BINDINGS)["results"]["bindings"]


def distinct_rows(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row per value of a binding: sources repeat rows, and optional parts multiply them."""
    from tallyframe.operators.temporal import newest

    return newest(rows.withColumn("_key", F.col("row")[key]), ["_key"], order).drop("_key")


def class_profile(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, n, sample): every class with its rows and one of their values, the most frequent first."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"), F.min(value).alias("sample"))
    return counts.orderBy(F.col("n").desc(), F.col(kind))


def extent(rows: DataFrame, day: str, key: str) -> DataFrame:
    """One row: first and last day, rows, distinct keys."""
    return rows.agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_rows"),
        F.count_distinct(key).alias("n_distinct"),
    )


def monthly_windows(spans: DataFrame) -> DataFrame:
    """(window_from, window_to) of (span_from, span_to): months, both ends inclusive, first and last clipped."""
    months = spans.select(
        "span_from", "span_to",
        F.explode(F.expr("sequence(trunc(span_from, 'MM'), span_to, interval 1 month)")).alias("_m"),
    )
    return months.select(
        F.greatest("span_from", "_m").alias("window_from"), F.least("span_to", F.last_day("_m")).alias("window_to")
    )
