"""From single votes to counts per ballot, group and party."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.temporal import fold_periods, group_at_date, holds_role, valid_values

# Which vote wins when a person appears more than once on a ballot. Values that share a number in the
# source (for, against and abstain) are told apart here so that the pick is total; `contradictions` reports them.
PRIORITY = {
    "for": 8, "against": 7, "abstain": 6, "secret_voter": 5, "president": 4, "not_voting": 3, "on_mission": 2,
    "absent": 1,
}
EXPRESSED = ("for", "against", "abstain")

# Vote type and description of the lower chamber, in the source's words.
TYPES = {"favorevole": "for", "contrario": "against", "astensione": "abstain", "ha votato": "secret_voter"}
NOT_VOTED = "non ha votato"
REASONS = {
    "": "not_voting", "non ha votato": "not_voting", "non ha partecipato": "absent", "in missione": "on_mission",
    "presidente di turno": "president",
}


def _choose(subject: Column, mapping: dict) -> Column:
    out = None
    for value, result in mapping.items():
        out = F.when(subject == value, result) if out is None else out.when(subject == value, result)
    return out


def decode_expression(kind: Column, description: Column) -> Column:
    """Vote expression, NULL when the pair is unknown (callers report those rows)."""
    known, reason = F.lower(F.trim(kind)), F.lower(F.trim(F.coalesce(description, F.lit(""))))
    return F.coalesce(_choose(known, TYPES), F.when(known == NOT_VOTED, _choose(reason, REASONS)))


def one_vote_per_person(vote_rows: DataFrame) -> DataFrame:
    """(ballot_id, person_id, group_id, expression): the vote of highest priority per person, with a group of a row that has
    that vote (the last by name; none if no such row has one).

    One maximum per vote, of primitive columns, keeps the aggregation in the code-generated hash path.
    """
    rank = _choose(F.col("expression"), PRIORITY)
    groups = [F.max(F.when(rank == r, F.col("group_id"))).alias(f"_g{r}") for r in PRIORITY.values()]
    picked = vote_rows.groupBy("ballot_id", "person_id").agg(F.max(rank).alias("_rank"), *groups)
    return picked.select(
        "ballot_id", "person_id", _choose(F.col("_rank"), {r: F.col(f"_g{r}") for r in PRIORITY.values()}).alias("group_id"),
        _choose(F.col("_rank"), {rank: value for value, rank in PRIORITY.items()}).alias("expression"),
    )


def contradictions(vote_rows: DataFrame) -> DataFrame:
    """People recorded with more than one of for / against / abstain on the same ballot."""
    kinds = sum(F.max((F.col("expression") == e).cast("int")) for e in EXPRESSED)
    return (
        vote_rows.filter(F.col("expression").isin(*EXPRESSED))
        .groupBy("ballot_id", "person_id").agg(kinds.alias("expressions"))
        .filter(F.col("expressions") > 1)
    )


def _tallies() -> list[Column]:
    cast = F.col("expression")
    return [
        F.count_if(cast == "for").alias("n_for"),
        F.count_if(cast == "against").alias("n_against"),
        F.count_if(cast == "abstain").alias("n_abstain"),
        F.count_if(~cast.isin(*EXPRESSED)).alias("n_other"),
    ]


COUNTS = ("n_for", "n_against", "n_abstain", "n_other")


def with_group(votes: DataFrame, memberships: DataFrame) -> DataFrame:
    """Votes without a group take the group the person belonged to on `on_date`; NULL when there was none."""
    found = group_at_date(votes, memberships, name="_group")
    return found.select(
        *[F.coalesce("group_id", "_group").alias("group_id") if c == "group_id" else F.col(c) for c in votes.columns]
    )


def ballot_group_counts(votes: DataFrame, memberships: DataFrame) -> DataFrame:
    """(ballot_id, group_id, n_for, n_against, n_abstain, n_other); the NULL group is a group of its own.

    A source vote that names its group is counted before any lookup. Votes without one are few; they are resolved,
    counted apart and added, so the membership join never touches the bulk of the votes.
    """
    named = votes.filter(F.col("group_id").isNotNull()).groupBy("ballot_id", "group_id").agg(*_tallies())
    rest = with_group(votes.filter(F.col("group_id").isNull()), memberships)
    resolved = rest.groupBy("ballot_id", "group_id").agg(*_tallies())
    return named.unionByName(resolved).groupBy("ballot_id", "group_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def ballot_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ballot_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def coherence(ballots: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds `coherent`: counted for / against / abstain equal the declared ones. A ballot without votes counts zero."""
    names = ("n_for", "n_against", "n_abstain")
    counted = totals.select("ballot_id", *[F.col(c).alias(f"_{c}") for c in names])
    same = F.lit(True)
    for c in names:
        same = same & (F.coalesce(F.col(f"_{c}"), F.lit(0)) == F.col(c))
    return ballots.join(counted, "ballot_id", "left").select(*ballots.columns, same.alias("coherent"))


def unattributed(votes: DataFrame, persons: DataFrame) -> DataFrame:
    """Votes of people the registry does not know, counted per ballot and expression."""
    unknown = votes.join(persons.select("person_id"), "person_id", "left_anti")
    return unknown.groupBy("ballot_id", "expression").agg(F.count("*").alias("n"))


TRACKED_SLUG = "^(lower|upper)-[0-9]+$"


def tracked_people(persons: DataFrame) -> DataFrame:
    """People with an identity of their own: the automatic ones carry the slug '<chamber>-<digits>'."""
    return persons.filter(~F.col("slug").rlike(TRACKED_SLUG))


def votes_to_keep(votes: DataFrame, persons: DataFrame, group_party: DataFrame) -> DataFrame:
    """Votes worth storing one by one: of tracked people, or of a group linked to several parties on the day."""
    tracked = tracked_people(persons).select("person_id", F.lit(True).alias("_tracked"))
    links = fold_periods(group_party, "group_id", "party_id", "_links")
    shared = F.size(valid_values(F.col("_links"), F.col("on_date"))) > 1
    return (
        votes.join(tracked, "person_id", "left")
        .join(links, "group_id", "left")
        .filter(F.col("_tracked").isNotNull() | F.coalesce(shared, F.lit(False)))
        .select(*votes.columns)
    )


def single_party_counts(counts: DataFrame, group_party: DataFrame) -> DataFrame:
    """Group counts of the groups linked to exactly one party row on the ballot's day, with that party.

    `counts` needs `on_date`; joint groups and groups without a link are left out.
    """
    linked = counts.join(fold_periods(group_party, "group_id", "party_id", "_links"), "group_id")
    owners = valid_values(F.col("_links"), F.col("on_date"))
    return linked.filter(F.size(owners) == 1).select(*counts.columns, F.get(owners, F.lit(0)).alias("party_id"))


def party_counts(counts: DataFrame, group_party: DataFrame) -> DataFrame:
    """(ballot_id, on_date, party_id, n_for, n_against, n_abstain), summed over the party's own groups."""
    return (
        single_party_counts(counts, group_party)
        .groupBy("ballot_id", "on_date", "party_id")
        .agg(*[F.sum(c).alias(c) for c in COUNTS[:3]])
    )


def with_government_bloc(by_party: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds the summed counts (gov_for, gov_against, gov_abstain) of the parties in government on the day."""
    flagged = holds_role(by_party, roles, "government", "in_government")
    ballot = Window.partitionBy("ballot_id")
    bloc = [
        F.sum(F.when(F.col("in_government"), F.col(c)).otherwise(0)).over(ballot).alias(c.replace("n_", "gov_"))
        for c in COUNTS[:3]
    ]
    return flagged.select("*", *bloc)


def tracked_positions_votes(votes: DataFrame, persons: DataFrame, ballots: DataFrame) -> DataFrame:
    """(ballot_id, subject_id, expression) of the tracked people on the given ballots."""
    people = tracked_people(persons).select("person_id", F.col("slug").alias("subject_id"))
    kept = votes.join(ballots.select("ballot_id"), "ballot_id", "left_semi")
    return kept.join(people, "person_id").select("ballot_id", "subject_id", "expression")


def source_counts(vote_rows: DataFrame) -> DataFrame:
    """Distinct people per (ballot, group, expression): the counts a source can deliver instead of single votes."""
    distinct = vote_rows.select("ballot_id", "group_id", "expression", "person_id").distinct()
    return distinct.groupBy("ballot_id", "group_id", "expression").agg(F.count("*").alias("n"))


VoteSource = Callable[[], dict[str, DataFrame]]


def counts_from_source(source: VoteSource) -> DataFrame:
    """A source is any callable returning its record tables by name. One that brings `source_counts` skips the
    counting of single votes; the others are counted here."""
    tables = source()
    if "source_counts" in tables:
        n = F.col("n")
        cast = F.col("expression")
        return tables["source_counts"].groupBy("ballot_id", "group_id").agg(
            F.coalesce(F.sum(F.when(cast == "for", n)), F.lit(0)).alias("n_for"),
            F.coalesce(F.sum(F.when(cast == "against", n)), F.lit(0)).alias("n_against"),
            F.coalesce(F.sum(F.when(cast == "abstain", n)), F.lit(0)).alias("n_abstain"),
            F.coalesce(F.sum(F.when(~cast.isin(*EXPRESSED), n)), F.lit(0)).alias("n_other"),
        )
    return ballot_group_counts(tables["votes"], tables["memberships"])
