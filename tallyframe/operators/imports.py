"""Import of ballots: each block of new ballots is stored with its counts, its kept votes and the votes nobody owns, together."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import votes as V
from tallyframe.storage import written
from tallyframe.tables import Ledger

# Fixed value: why a vote stays without a person.
UNKNOWN_PERSON = "unknown identifier"


def unstored(ledger: Ledger, ballots: DataFrame) -> DataFrame:
    """The ballots that no committed block holds."""
    return ballots.join(ledger.read("ballots").select("chamber", "term", "ext_id"), ["chamber", "term", "ext_id"], "left_anti")


def block_tables(ledger: Ledger, ballots: DataFrame, votes: DataFrame, memberships: DataFrame, persons: DataFrame, group_party: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """The four tables of the ballots that are not stored yet.

    ballots: with declared totals and `coherent` filled here; counts: (ballot, group) tallies, votes without a group counted in
    the group of the day; kept: votes of tracked people and of groups with several parties; unattributed: votes of people the
    registry does not know.
    """
    new = unstored(ledger, ballots)
    mine = votes.join(new.select("ballot_id"), "ballot_id", "left_semi")

    @cache
    def counts() -> DataFrame:  # stored, and summed for the ballots: counted once
        return written(V.ballot_group_counts(mine, memberships), "counts")

    def kept() -> DataFrame:
        known = V.with_group(mine, memberships).join(persons.select("person_id"), "person_id", "left_semi")
        return V.votes_to_keep(known, persons, group_party)

    def unattributed() -> DataFrame:
        return mine.join(persons.select("person_id"), "person_id", "left_anti").select("ballot_id", "person_id", F.lit(UNKNOWN_PERSON).alias("reason"))

    return {"counts": counts, "kept": kept, "unattributed": unattributed, "ballots": lambda: V.coherence(new, V.ballot_totals(counts()))}


def import_block(ledger: Ledger, block: str, ballots: DataFrame, *tables: DataFrame) -> str | None:
    """Stores a block of ballots and returns its version. A block that was stored adds nothing, not even a look at the votes;
    one that failed is as if it had never begun."""
    if unstored(ledger, ballots).isEmpty():
        return None
    return ledger.write(block, block_tables(ledger, ballots, *tables))
