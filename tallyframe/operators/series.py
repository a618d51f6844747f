"""Quarterly {n, d} series and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import rules
from tallyframe.functions.dates import mid_quarter, quarter_start
from tallyframe.operators.temporal import holds_role
from tallyframe.operators.votes import party_counts, with_government_bloc
from tallyframe.params import DEFAULT, Params

WITH_GOVERNMENT = "votes_with_government"
UNITED = "votes_united"


def fill_quarters(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row per key and quarter from the first to the last quarter of the whole table, zero where absent.

    `df` is already aggregated to one row per (key, quarter), so the two windows run over keys x quarters rows. Each
    row also emits the empty quarters up to the next one: no calendar table and no cross join.
    """
    whole = Window.partitionBy()
    by_key = Window.partitionBy(key).orderBy("quarter")
    spans = (
        df.withColumn("_first", F.min("quarter").over(whole))
        .withColumn("_last", F.max("quarter").over(whole))
        .withColumn("_prev", F.lag("quarter").over(by_key))
        .withColumn("_next", F.lead("quarter").over(by_key))
        .withColumn("_from", F.when(F.col("_prev").isNull(), F.col("_first")).otherwise(F.col("quarter")))
        .withColumn("_to", F.coalesce(F.add_months("_next", -3), "_last"))
    )
    filled = spans.withColumn("_q", F.explode(F.expr("sequence(_from, _to, interval 3 months)")))
    here = F.col("_q") == F.col("quarter")
    return filled.select(
        key, F.col("_q").alias("quarter"), *[F.when(here, F.col(c)).otherwise(0).alias(c) for c in values]
    )


def trend_flags(by_party: DataFrame, roles: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per ballot and party: counted (enough voters), united, comparable, agrees with the government bloc.

    The minimum of voters applies to the party, not to the bloc; a tie of either side removes the ballot from the
    comparison only.
    """
    own = [F.col(c) for c in ("n_for", "n_against", "n_abstain")]
    gov = [F.col(c) for c in ("gov_for", "gov_against", "gov_abstain")]
    return (
        with_government_bloc(by_party, roles)
        .withColumn("counted", rules.voters(*own) >= p.min_members)
        .withColumn("united", rules.is_united(*own, p))
        .withColumn("choice", rules.prevailing(*own))
        .withColumn("gov_choice", rules.prevailing(*gov))
    )


def trend_series(
    counts: DataFrame, ballots: DataFrame, group_party: DataFrame, roles: DataFrame, p: Params = DEFAULT
) -> DataFrame:
    """(party_id, quarter, metric, n, d, in_government), dense from the first to the last quarter.

    Final, non-secret ballots of the reference term. `votes_united`: ballots on which at least nine voters in ten made
    the same choice. `votes_with_government`: ballots on which the party's choice is that of the government bloc.
    """
    wanted = ballots.filter(
        F.col("is_final") & ~F.col("is_secret") & (F.col("term") == p.reference_term)
    ).select("ballot_id", F.col("ballot_date").alias("on_date"))
    by_party = party_counts(counts.join(wanted, "ballot_id"), group_party)
    counted = F.col("counted")
    comparable = counted & F.col("choice").isNotNull() & F.col("gov_choice").isNotNull()
    per_quarter = (
        trend_flags(by_party, roles, p)
        .groupBy("party_id", quarter_start(F.col("on_date")).alias("quarter"))
        .agg(
            F.count_if(comparable & (F.col("choice") == F.col("gov_choice"))).alias("gov_n"),
            F.count_if(comparable).alias("gov_d"),
            F.count_if(counted & F.col("united")).alias("united_n"),
            F.count_if(counted).alias("united_d"),
        )
    )
    dense = fill_quarters(per_quarter, "party_id", ["gov_n", "gov_d", "united_n", "united_d"])
    dense = dense.withColumn("on_date", mid_quarter(F.col("quarter")))
    metrics = F.array(
        F.struct(F.lit(WITH_GOVERNMENT).alias("metric"), F.col("gov_n").alias("n"), F.col("gov_d").alias("d")),
        F.struct(F.lit(UNITED).alias("metric"), F.col("united_n").alias("n"), F.col("united_d").alias("d")),
    )
    return (
        holds_role(dense, roles, "government", "in_government")
        .withColumn("_m", F.explode(metrics))
        .select("party_id", "quarter", "_m.metric", "_m.n", "_m.d", "in_government")
    )


def whole_series(series: DataFrame) -> DataFrame:
    return series.groupBy("party_id", "metric").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def year_over_year(series: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Last four quarters against the four before, per party and metric, with the verdict."""
    back = F.row_number().over(Window.partitionBy("party_id", "metric").orderBy(F.col("quarter").desc()))
    place = F.col("_back")
    sums = (
        series.withColumn("_back", back)
        .groupBy("party_id", "metric")
        .agg(
            F.count("*").alias("quarters"),
            *[
                F.coalesce(F.sum(F.when(place.between(a, b), F.col(c))), F.lit(0)).alias(f"{c}_{name}")
                for name, a, b in (("now", 1, 4), ("before", 5, 8))
                for c in ("n", "d")
            ],
        )
    )
    enough = (
        (F.col("quarters") >= 8) & (F.col("d_now") >= p.min_denominator) & (F.col("d_before") >= p.min_denominator)
    )
    verdict = rules.year_verdict(*[F.col(c) for c in ("n_now", "d_now", "n_before", "d_before")], enough)
    return sums.withColumn("verdict", verdict)


def visible_points(series: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Flags quarters with enough cases and numbers the unbroken runs: a line never bridges a hidden quarter."""
    order = Window.partitionBy("party_id", "metric").orderBy("quarter")
    shown = F.col("d") >= p.min_denominator
    starts = shown & ~F.coalesce(F.lag(shown).over(order), F.lit(False))
    return (
        series.withColumn("visible", shown)
        .withColumn("_starts", starts.cast("int"))
        .withColumn("segment", F.when(F.col("visible"), F.sum("_starts").over(order)))
        .drop("_starts")
    )
