"""Lookups on validity periods and newest-version views.

A period table is first folded to one row per key holding that key's periods, and the facts meet it by plain equality:
one pass over the facts, at most one shuffle, no range join and no rows multiplied. A fold is as long as the history of
one key (the parties of a group, the memberships of a person), never as long as the facts of that key. No side is
force-broadcast: Spark broadcasts the folded table when its measured size allows it, and otherwise sort-merges with
skew splitting for keys that hold a large part of the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.dates import valid_at


def newest(df: DataFrame, keys: list[str], order: list[Column], rank: int = 1) -> DataFrame:
    """First `rank` rows per key under `order`.

    The filter on row_number lets Spark prune each map task to `rank` rows per key before the shuffle
    (WindowGroupLimit), so a hot key is not collected in one place.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= rank).drop("_place")


def fold_periods(periods: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the key's periods as an array of (valid_from, value, valid_to)."""
    entry = F.struct("valid_from", F.col(value).alias("value"), "valid_to")
    return periods.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(entry).alias(name))


def valid_entries(folded: Column, day: Column) -> Column:
    return F.filter(folded, lambda e: valid_at(day, e["valid_from"], e["valid_to"]))


def valid_values(folded: Column, day: Column) -> Column:
    return F.transform(valid_entries(folded, day), lambda e: e["value"])


def sole(values: Column) -> Column:
    """The only distinct value of an array, else NULL."""
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def party_at_date(facts: DataFrame, group_party: DataFrame, memberships: DataFrame, day: str = "on_date") -> DataFrame:
    """Adds `party_id` to (person_id, group_id, on_date) facts.

    The group's party when exactly one distinct party is linked on that day; else the person's own party under the
    same rule; else NULL. Never a guess.
    """
    own = memberships.filter(F.col("kind") == "party")
    on = F.col(day)
    return (
        facts.join(fold_periods(group_party, "group_id", "party_id", "_links"), "group_id", "left")
        .join(fold_periods(own, "person_id", "party_id", "_own"), "person_id", "left")
        .select(
            *facts.columns,
            F.coalesce(sole(valid_values(F.col("_links"), on)), sole(valid_values(F.col("_own"), on))).alias("party_id"),
        )
    )


def group_at_date(facts: DataFrame, memberships: DataFrame, day: str = "on_date", name: str = "group_id") -> DataFrame:
    """Adds the group of (person_id, on_date) facts: the valid membership that started last; the larger id on a tie."""
    groups = memberships.filter(F.col("kind") == "group")
    last = F.array_max(valid_entries(F.col("_periods"), F.col(day)))
    return facts.join(fold_periods(groups, "person_id", "group_id", "_periods"), "person_id", "left").select(
        *facts.columns, last["value"].alias(name)
    )


def holds_role(
    facts: DataFrame, roles: DataFrame, role: str, name: str, party: str = "party_id", day: str = "on_date"
) -> DataFrame:
    """Adds the flag `name`: the party holds the role on the day."""
    held = fold_periods(roles.filter(F.col("role") == role), "party_id", "role", "_roles")
    held = held.withColumnRenamed("party_id", party)
    flag = F.coalesce(F.size(valid_entries(F.col("_roles"), F.col(day))) > 0, F.lit(False))
    return facts.join(held, party, "left").select(*facts.columns, flag.alias(name))


def current_act(ballots: DataFrame, corrections: DataFrame) -> DataFrame:
    """(ballot_id, act_ref, act_title): the last correction even when it clears the title, else the original."""
    last = newest(corrections, ["ballot_id"], [F.col("recorded_at").desc()]).select(
        "ballot_id", F.col("act_ref").alias("_ref"), F.col("act_title").alias("_title"), F.lit(True).alias("_corrected")
    )
    corrected = F.col("_corrected").isNotNull()
    return ballots.select("ballot_id", "act_ref", "act_title").join(last, "ballot_id", "left").select(
        "ballot_id",
        F.when(corrected, F.col("_ref")).otherwise(F.col("act_ref")).alias("act_ref"),
        F.when(corrected, F.col("_title")).otherwise(F.col("act_title")).alias("act_title"),
    )


def acts_to_correct(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming acts of stored ballots that differ, NULL-safely, from the act in force."""
    held = current.select("ballot_id", F.col("act_ref").alias("_ref"), F.col("act_title").alias("_title"))
    same = F.col("act_ref").eqNullSafe(F.col("_ref")) & F.col("act_title").eqNullSafe(F.col("_title"))
    return incoming.join(held, "ballot_id").filter(~same).select(*incoming.columns)
