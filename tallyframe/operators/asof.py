"""The nearest earlier or later row of a key, and what is decided with it: claims against official series, promises against acts.

Rows that ask and rows that answer are put in one sorted line per key and stretch of time, where each asks the last answer it
has passed. What a stretch itself cannot answer comes from the stretches before it, of which one row each is kept. A key that
holds a large part of all rows is so many stretches, not one task, and no pair of rows is ever formed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(asks: DataFrame, answers: DataFrame, key: str, day: str, name: str, forward: bool = False, stretch: str = "month") -> DataFrame:
    """Adds `name`, a struct of the other columns of the answer of the same key that is last on or before the ask's day (first
    on or after it, if `forward`), NULL when there is none. Of several answers of a day the greatest, column by column, counts.

    answers: key, day and what is told. A NULL key or day has no answer.
    """
    told = [c for c in answers.columns if c not in (key, day)]
    value = F.struct(F.col(day).alias("_day"), *told)
    sign = -1 if forward else 1

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("_stretch", F.trunc(day, stretch)).withColumn("_at", sign * F.unix_date(day))

    offered = placed(answers.filter(F.col(key).isNotNull() & F.col(day).isNotNull())).select(key, "_stretch", "_at", value.alias("_told"))
    line = placed(asks).withColumn("_asks", F.lit(1)).unionByName(
        offered.withColumn("_asks", F.lit(0)), allowMissingColumns=True
    )
    inside = Window.partitionBy(key, "_stretch").orderBy("_at", "_asks", "_told").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("_own", F.last("_told", ignorenulls=True).over(inside)).filter("_asks = 1")
    # the answer that each stretch hands on; of equal days the greatest, in both directions
    last = offered.groupBy(key, "_stretch").agg(F.max(F.struct("_at", "_told")).alias("_last"))
    stretches = line.select(key, "_stretch").distinct().join(last, [key, "_stretch"], "full")
    before = Window.partitionBy(key).orderBy(sign * F.unix_date("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    handed = stretches.select(key, "_stretch", F.last("_last._told", ignorenulls=True).over(before).alias("_handed")).filter("_handed IS NOT NULL")
    found = F.coalesce("_own", "_handed")
    told_struct = F.when(found.isNotNull(), F.struct(found["_day"].alias(day), *[found[c].alias(c) for c in told]))
    return line.join(handed, [key, "_stretch"], "left").select(*asks.columns, told_struct.alias(name))


# ---- claims against official series ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tolerance:
    """How far a declared value may be off: a share of the official value, and an amount (none: the share alone decides)."""

    relative: str
    absolute: str | None = None


LEVEL, CHANGE = "level", "change"


def judged_claims(claims: DataFrame, observations: DataFrame, units: DataFrame, tolerances: dict[str, Tolerance]) -> DataFrame:
    """Adds (official, outcome, rule) to claims (series, kind, since, until, declared, unit).

    observations: series, on_date, value, in the series' own unit. units: series, unit, factor (declared x factor is in the
    series' unit). A level is the value at `until`; a change the value at `until` less the one at `since`. Outcome:
    'unverifiable' (series_missing, unit_mismatch); 'supported' within the tolerance; 'imprecise' within twice the share;
    else 'contradicted'. Values are decimals, compared exactly.
    """
    number = "decimal(18,4)"
    seen = observations.select("series", "on_date", F.col("value").cast(number).alias("value"))
    asked = claims.withColumn("on_date", F.col("until"))
    asked = nearest(asked, seen, "series", "on_date", "_end").withColumn("on_date", F.col("since"))
    asked = nearest(asked, seen, "series", "on_date", "_start").drop("on_date")
    official = F.when(F.col("kind") == LEVEL, F.col("_end.value")).when(F.col("kind") == CHANGE, F.col("_end.value") - F.col("_start.value")).cast(number)
    known = asked.withColumn("official", official).join(units.select("series", "unit", F.col("factor").cast("decimal(12,6)").alias("_factor")), ["series", "unit"], "left")
    off = F.abs((F.col("declared").cast(number) * F.col("_factor")).cast(number) - F.col("official"))

    def within(times: int) -> Column:
        rule = F.lit(False)
        for kind, t in tolerances.items():
            share = (F.lit(t.relative).cast("decimal(6,4)") * F.abs("official") * F.lit(times).cast("decimal(1,0)")).cast("decimal(38,8)")
            near = (F.col("official") != 0) & (off <= share)
            if times == 1 and t.absolute is not None:
                near = near | (off <= F.lit(t.absolute).cast(number))
            rule = rule | ((F.col("kind") == kind) & near)
        return rule

    rule = (
        F.when(F.col("official").isNull(), "series_missing").when(F.col("_factor").isNull(), "unit_mismatch")
        .when(within(1), "within").when(within(2), "within_double").otherwise("beyond")
    )
    outcomes = {"series_missing": "unverifiable", "unit_mismatch": "unverifiable", "within": "supported", "within_double": "imprecise", "beyond": "contradicted"}
    named = F.create_map(*[F.lit(x) for pair in outcomes.items() for x in pair])
    return known.withColumn("rule", rule).withColumn("outcome", named[F.col("rule")]).select(*claims.columns, "official", "outcome", "rule")


# ---- promises against acts ------------------------------------------------------------------------------------------


def promise_status(promises: DataFrame, acts: DataFrame, party_votes: DataFrame) -> DataFrame:
    """Adds (status, act_id, act_date) to promises (promise_id, party_id, topic, made_on, until, agreed).

    acts: topic, act_id, act_date, approved, partial. party_votes: act_id, party_id, against. The act that decides is the first
    approved one of the topic from the day of the promise to the end of its period: a whole one before a partial one.
    'to_verify' while the link of promise and topic is not agreed; 'not_kept' without an approved act in the period, or when the
    party voted against the act; 'halfway' for a partial act; 'kept' else.
    """
    asked = promises.withColumn("act_date", F.col("made_on"))
    for name, partial in (("_whole", False), ("_part", True)):
        some = acts.filter(F.col("approved") & (F.col("partial") == partial)).select("topic", "act_date", "act_id")
        asked = nearest(asked, some, "topic", "act_date", name, forward=True)
        asked = asked.withColumn(name, F.when(F.col(f"{name}.act_date") <= F.col("until"), F.col(name)))
    decided = asked.drop("act_date").withColumn("_act", F.coalesce("_whole", "_part"))
    against = party_votes.filter("against").select(F.col("act_id").alias("_id"), F.col("party_id").alias("_party"), F.lit(True).alias("_against")).distinct()
    joined = decided.join(against, (F.col("_act.act_id") == F.col("_id")) & (F.col("party_id") == F.col("_party")), "left")
    status = (
        F.when(~F.coalesce("agreed", F.lit(False)), "to_verify").when(F.col("_act").isNull() | F.col("_against"), "not_kept")
        .when(F.col("_whole").isNull(), "halfway").otherwise("kept")
    )
    counted = F.col("status") != "to_verify"
    return joined.withColumn("status", status).select(
        *promises.columns, "status", F.when(counted, F.col("_act.act_id")).alias("act_id"), F.when(counted, F.col("_act.act_date")).alias("act_date")
    )
