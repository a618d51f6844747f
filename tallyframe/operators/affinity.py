"""Agreement between respondents' answers and subjects' positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import rules
from tallyframe.operators.temporal import newest
from tallyframe.params import DEFAULT, Params

CATEGORIES = ("agree", "disagree", "neutral", "missing")


def latest_answers(answer_rows: DataFrame) -> DataFrame:
    """One answer per respondent and statement, the newest; the event id breaks ties."""
    return newest(answer_rows, ["respondent_id", "statement_id"], [F.col("ts").desc(), F.col("event_id").desc()])


def scored(answers: DataFrame, positions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per answer with an opinion and subject: category, points and maximum.

    Skipped answers (NULL) and 'no opinion' (0) do not count. `positions` holds every subject for every statement.
    """
    opinions = answers.filter(F.col("value").isNotNull() & (F.col("value") != 0)).select(
        "respondent_id", "statement_id", F.col("value").alias("answer"),
        F.when(F.col("important"), p.important_weight).otherwise(1).alias("weight"),
    )
    held = positions.select("subject_id", "statement_id", F.col("value").alias("position"))
    answer, position, weight = F.col("answer"), F.col("position"), F.col("weight")
    return opinions.join(held, "statement_id").select(
        "respondent_id", "subject_id", "statement_id", answer, position, weight,
        rules.answer_category(answer, position).alias("category"),
        F.coalesce(rules.score_points(answer, position) * weight, F.lit(0)).alias("points"),
        F.when(position.isNotNull(), 4 * weight).otherwise(0).alias("maximum"),
    )


def affinity(answers: DataFrame, positions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(respondent_id, subject_id, affinity, answered, agree, disagree, neutral, missing) with statement lists.

    A list is as long as the catalogue at most. Affinity is a whole percent, NULL when nothing can be compared.
    """
    lists = [
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.col("statement_id")))), ",").alias(c)
        for c in CATEGORIES
    ]
    sums = scored(answers, positions, p).groupBy("respondent_id", "subject_id").agg(
        F.sum("points").alias("_points"), F.sum("maximum").alias("_maximum"), F.count("*").alias("answered"), *lists
    )
    return sums.select(
        "respondent_id", "subject_id", rules.percent(F.col("_points"), F.col("_maximum")).alias("affinity"), "answered",
        *CATEGORIES,
    )


def affinity_scores(answers: DataFrame, positions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """As `affinity`, numbers only: everything stays in hash aggregation."""
    sums = scored(answers, positions, p).groupBy("respondent_id", "subject_id").agg(
        F.sum("points").alias("_points"), F.sum("maximum").alias("_maximum")
    )
    return sums.select(
        "respondent_id", "subject_id", rules.percent(F.col("_points"), F.col("_maximum")).alias("affinity")
    )


def ranked(scores: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds `place` (affinity descending, unknown last, then id) , `leader` and `nobody`.

    Leaders are all subjects within the margin of the best one. `nobody`: even the best is below the threshold.
    """
    mine = Window.partitionBy("respondent_id")
    best = F.max("affinity").over(mine)
    order = mine.orderBy(F.coalesce("affinity", F.lit(-1)).desc(), F.col("subject_id"))
    return (
        scores.withColumn("place", F.row_number().over(order))
        .withColumn("_best", best)
        .withColumn("leader", F.coalesce(F.col("affinity") >= F.col("_best") - p.tie_margin, F.lit(False)))
        .withColumn("nobody", F.coalesce(F.col("_best") < p.nobody_below, F.lit(False)))
        .drop("_best")
    )


def area_means(positions: DataFrame, areas: DataFrame) -> DataFrame:
    """Mean known position per area and statement, as sum and count; an area without any has mean zero."""
    named = positions.join(areas, "subject_id", "left").withColumn("area", F.coalesce("area", F.lit("other")))
    return named.groupBy("area", "statement_id").agg(
        F.coalesce(F.sum("value"), F.lit(0)).alias("total"), F.count("value").alias("known"),
        F.coalesce(F.round(F.avg("value"), 6), F.lit(0.0)).alias("mean"),
    )


def mean_affinity(scores: DataFrame) -> DataFrame:
    """Mean affinity per subject over the profiles that can be compared, to one decimal."""
    return scores.filter(F.col("affinity").isNotNull()).groupBy("subject_id").agg(
        (F.floor((20 * F.sum("affinity") + F.count("*")) / (2 * F.count("*"))) / 10).alias("mean_affinity")
    )


def first_place_shares(rank_rows: DataFrame, areas: DataFrame, profiles: DataFrame) -> DataFrame:
    """(area, first_share): a profile with k leaders gives 1/k to the area of each, over all profiles."""
    area = F.coalesce("area", F.lit("other"))
    leaders = rank_rows.filter("leader").join(areas, "subject_id", "left").withColumn("area", area)
    shared = leaders.withColumn("_k", F.count("*").over(Window.partitionBy("respondent_id")))
    total = profiles.agg(F.count("*").alias("n")).scalar()
    # Exact ties split: add the leaders up by k before dividing, so the sum has few terms and no rounding drift.
    by_k = shared.groupBy("area", "_k").agg(F.count("*").alias("_n"))
    return by_k.groupBy("area").agg(F.round(F.sum(F.col("_n") / F.col("_k")) / total, 3).alias("first_share"))


def balance_audit(
    scores: DataFrame, areas: DataFrame, profiles: DataFrame, p: Params = DEFAULT
) -> DataFrame:
    """Violations (check, key, detail) of a questionnaire's balance over a table of response profiles.

    Mean affinity of each subject must stay near 50, and each area must come first about as often as its share of the
    subjects.
    """
    means = mean_affinity(scores).filter(F.abs(F.col("mean_affinity") - 50) > p.mean_affinity_tolerance).select(
        F.lit("mean_affinity").alias("check"), F.col("subject_id").alias("key"),
        F.format_string("%.1f", "mean_affinity").alias("detail"),
    )
    sizes = areas.groupBy("area").agg(F.count("*").alias("_n"))
    all_subjects = areas.agg(F.count("*").alias("n")).scalar()
    shares = sizes.join(first_place_shares(ranked(scores, p), areas, profiles), "area", "left").select(
        "area", F.coalesce("first_share", F.lit(0.0)).alias("first_share"), (F.col("_n") / all_subjects).alias("_expected")
    )
    gap = F.abs(F.col("first_share") - F.col("_expected")) * 100
    firsts = shares.filter(gap > p.first_share_tolerance).select(
        F.lit("first_share").alias("check"), F.col("area").alias("key"),
        F.format_string("%.3f", "first_share").alias("detail"),
    )
    return means.unionByName(firsts)


def area_recognition(rank_rows: DataFrame, areas: DataFrame, profile_areas: DataFrame) -> DataFrame:
    """(area, recognised): how often people who answer like an area find it first; ties count 1/k."""
    leaders = rank_rows.filter("leader").join(areas, "subject_id", "left")
    per_profile = leaders.join(profile_areas, "respondent_id").groupBy("respondent_id", "profile_area").agg(
        F.count_if(F.coalesce("area", F.lit("other")) == F.col("profile_area")).alias("_hits"), F.count("*").alias("_k")
    )
    by_kind = per_profile.groupBy("profile_area", "_hits", "_k").agg(F.count("*").alias("_n"))
    return by_kind.groupBy(F.col("profile_area").alias("area")).agg(
        F.round(F.sum(F.col("_n") * F.col("_hits") / F.col("_k")) / F.sum("_n"), 3).alias("recognised")
    )
