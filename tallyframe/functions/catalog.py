"""Functions of the session catalogue, so that plain SQL asks what the operators answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.temporal import fold_periods


def register_party_at_date(spark: SparkSession, group_party: DataFrame, memberships: DataFrame, name: str = "party_at_date") -> None:
    """Makes `name(person, group, day)` callable from SQL: the party that `temporal.party_at_date` gives.

    The periods of each group and person are folded into two views; the function looks its group and person up by equality, so
    the optimiser turns its calls over a table into two joins.
    """
    fold_periods(group_party, "group_id", "party_id", "periods").createOrReplaceTempView(f"{name}_groups")
    fold_periods(memberships.filter(F.col("kind") == "party"), "person_id", "party_id", "periods").createOrReplaceTempView(f"{name}_persons")
    kinds = {c: t for df in (group_party, memberships) for c, t in df.dtypes}

    party = kinds["party_id"]
    valid = "filter(periods, e -> e.valid_from <= day AND (e.valid_to IS NULL OR day <= e.valid_to))"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}_sole(periods ARRAY<STRUCT<valid_from: DATE, value: {party}, valid_to: DATE>>, day DATE) RETURNS {party}
        RETURN CASE WHEN size(array_distinct(transform({valid}, e -> e.value))) = 1 THEN get({valid}, 0).value END""")

    def held(view: str, column: str, given: str) -> str:
        return f"{name}_sole((SELECT first(periods) FROM {name}_{view} WHERE {column} = {given}), day)"

    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(person {kinds['person_id']}, grp {kinds['group_id']}, day DATE) RETURNS {party}
        RETURN coalesce({held('groups', 'group_id', 'grp')}, {held('persons', 'person_id', 'person')})""")
