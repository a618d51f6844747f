"""Fixed-rule readings of {n, d} metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import rules
from tallyframe.params import DEFAULT, Params


def metrics_of(subjects: DataFrame) -> DataFrame:
    """(subject_id, metric, n, d) from one wide row per subject; a metric without a denominator is left out."""
    pairs = {
        "wrong_numbers": ("wrong", "checked"), "vague": ("vague", "claims"), "contrary_votes": ("contrary", "comparable"),
    }
    entries = [
        F.struct(F.lit(m).alias("metric"), F.col(n).cast("long").alias("n"), F.col(d).cast("long").alias("d"))
        for m, (n, d) in pairs.items()
    ]
    broken = F.struct(
        F.lit("promises_not_kept").alias("metric"),
        (F.col("promises") - F.col("kept")).cast("long").alias("n"), F.col("promises").cast("long").alias("d"),
    )
    rows = subjects.select("subject_id", F.explode(F.array(*entries, broken)).alias("_m"))
    return rows.select("subject_id", "_m.*").filter(F.col("d").isNotNull())


def pooled(metrics: DataFrame) -> DataFrame:
    """Sums over all subjects per metric; a metric that never had a case is left out."""
    sums = metrics.groupBy("metric").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return sums.filter(F.col("d") > 0)


def extremes(metrics: DataFrame, directions: dict[str, str], p: Params = DEFAULT) -> DataFrame:
    """(metric, names, n, d): the subjects with the highest (or lowest) share, all ties named.

    Only subjects at or above the minimum denominator, and only metrics where at least two remain. Division of whole
    numbers is correctly rounded, so equal shares such as 1/3 and 10/30 give the same double and tie. Only the extreme
    of each metric travels, never the group.
    """
    enough = metrics.filter((F.col("d") >= p.min_denominator) & F.col("metric").isin(*directions))
    lowest = [m for m, way in directions.items() if way == "min"]
    share = F.col("n") / F.col("d")
    signed = F.when(F.col("metric").isin(*lowest), -share).otherwise(share)
    keyed = enough.withColumn("_s", signed)
    tops = keyed.groupBy("metric").agg(F.max("_s").alias("_s"), F.count("*").alias("_rivals"))
    winners = keyed.join(tops.filter(F.col("_rivals") >= 2), ["metric", "_s"])
    first = F.min(F.struct("subject_id", "n", "d"))
    return winners.groupBy("metric").agg(
        F.count("*").alias("winners"), first.alias("_f"),
        F.array_join(F.array_sort(F.collect_list("subject_id")), " e ").alias("names"),
    ).select("metric", "names", "winners", F.col("_f.n").alias("n"), F.col("_f.d").alias("d"))


def number_sentences(metrics: DataFrame, sentence_rules: list[tuple[str | None, str]]) -> DataFrame:
    return metrics.select(
        "subject_id", "metric", rules.first_sentence(sentence_rules, F.col("n"), F.col("d")).alias("sentence")
    )
