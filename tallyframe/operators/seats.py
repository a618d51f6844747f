"""Who sits where on a day, and the current roles of tracked subjects."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.dates import active_at, valid_at
from tallyframe.operators.temporal import holds_role, newest, party_at_date


def members_at(memberships: DataFrame, persons: DataFrame, day: date) -> DataFrame:
    """(person_id, chamber, group_id, on_date): the latest group membership valid on the day."""
    on = F.lit(day)
    groups = memberships.filter(
        (F.col("kind") == "group") & valid_at(on, F.col("valid_from"), F.col("valid_to"))
    ).join(persons.select("person_id", "chamber"), "person_id")
    order = [F.col("valid_from").desc(), F.col("group_id").desc()]
    return newest(groups, ["person_id", "chamber"], order).select(
        "person_id", "chamber", "group_id", on.alias("on_date")
    )


def seats(
    memberships: DataFrame, persons: DataFrame, group_party: DataFrame, tracked: list[int], day: date
) -> DataFrame:
    """(chamber, holder, seats): every tracked party (zero included), 'others' and 'total'.

    `tracked` is the registry's list of parties, so all holders are counted in one aggregation per chamber.
    """
    members = party_at_date(members_at(memberships, persons, day), group_party, memberships)
    party = F.col("party_id")
    held = party.isin(*tracked)
    per_chamber = members.groupBy("chamber").agg(
        F.count("*").alias("total"),
        F.count_if(party.isNull() | ~held).alias("others"),
        *[F.count_if(party == t).alias(f"party-{t}") for t in tracked],
    )
    return per_chamber.unpivot("chamber", ["total", "others", *[f"party-{t}" for t in tracked]], "holder", "seats")


def seats_by_role(seat_rows: DataFrame, roles: DataFrame, day: date) -> DataFrame:
    """Seats of government and opposition parties per chamber, and of the rest."""
    on = F.lit(day)
    now = roles.filter(active_at(on, F.col("valid_from"), F.col("valid_to"))).select(
        F.concat(F.lit("party-"), F.col("party_id").cast("string")).alias("holder"), "role"
    )
    return (
        seat_rows.filter(F.col("holder") != "total")
        .join(now, "holder", "left")
        .groupBy("chamber", F.coalesce("role", F.lit("none")).alias("role"))
        .agg(F.sum("seats").alias("seats"))
    )


def subject_roles(parties: DataFrame, roles: DataFrame, leaders: DataFrame, day: date) -> DataFrame:
    """(party_id, role_text, leaders): the role on the day in words, and who leads the party in registry order.

    `leaders` has (party_id, ord, name): the tracked people of a party, a hand-kept list.
    """
    dated = parties.withColumn("on_date", F.lit(day))
    flagged = holds_role(holds_role(dated, roles, "government", "_gov"), roles, "opposition", "_opp")
    names = leaders.groupBy("party_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda e: e["name"]), ", ").alias(
            "leaders"
        )
    )
    text = F.when(F.col("_gov"), "In government").when(F.col("_opp"), "In opposition").otherwise("Outside parliament")
    return flagged.select("party_id", text.alias("role_text")).join(names, "party_id", "left")
