"""A release as a whole: its sections written together, checked against each other as they were written, and only then declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import sinks
from tallyframe.operators import quality as Q

SECTIONS = ("subjects", "questions", "positions", "series", "seats", "programmes", "corrections")
MIN_REASON = 3
NOT_SUBJECTS = ("others", "total")  # holders of seats that are no subject


class BrokenRelease(ValueError):
    """What was written does not hold together; the release is not declared."""


def _unknown(check: str, rows: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """Values of a column that are no identifier of the known table, with the number of rows that name them."""
    named = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    lost = named.join(known.select(F.col(name).alias("_v")), "_v", "left_anti")
    return Q.failing(lost, check, ["_v"], F.lit(True), F.col("_n"))


def _when(flag: bool, column: Column) -> Column:
    return column if flag else F.lit(False)


def violations(sections: dict[str, DataFrame], flags: dict[str, bool], themes: list[str]) -> DataFrame:
    """(check, key, detail) of everything that does not hold together.

    subjects (id, kind, party_id): ids are single, a subject's party is a subject. questions (id): a release that promises
    positions has some. positions (subject_id, statement_id): both known. series (party_id, metric, quarter, n, d): subjects,
    complete, n not above d. seats (chamber, holder, seats): holders known, sums right. programmes (party_id, document_id,
    promises, precise, themes): subjects, counts inside each other. corrections (object, reason): reasons given.
    """
    subjects, questions = sections["subjects"], sections["questions"]
    ids = subjects.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    found = Q.failing(ids, "repeated_subject", ["id"], F.col("_n") > 1, F.col("_n"))
    asked = questions.agg(F.count(F.lit(1)).alias("_n"))
    found = found.unionByName(Q.failing(asked.withColumn("_k", F.lit("positions")), "section_without_rows", ["_k"], _when(flags.get("positions", False), F.col("_n") == 0), F.col("_n")))
    found = found.unionByName(_unknown("party_of_subject", subjects, "party_id", ids, "id"))
    found = found.unionByName(_unknown("subject_of_position", sections["positions"], "subject_id", ids, "id"))
    found = found.unionByName(_unknown("question_of_position", sections["positions"], "statement_id", questions, "id"))
    found = found.unionByName(_unknown("party_of_series", sections["series"], "party_id", ids, "id"))
    holders = sections["seats"].filter(~F.col("holder").isin(*NOT_SUBJECTS))
    found = found.unionByName(_unknown("party_of_seats", holders, "holder", ids, "id"))
    found = found.unionByName(_unknown("party_of_programme", sections["programmes"], "party_id", ids, "id"))
    found = found.unionByName(Q.series_shape(sections["series"])).unionByName(Q.seat_sums(sections["seats"]))
    found = found.unionByName(Q.programme_sums(sections["programmes"], themes))
    short = F.length(F.trim(F.coalesce("reason", F.lit("")))) < MIN_REASON
    return found.unionByName(Q.failing(sections["corrections"], "correction_without_reason", ["object"], short, F.col("reason")))


def publish(sections: dict[str, DataFrame], folder: str, version: str, flags: dict[str, bool], themes: list[str]) -> DataFrame:
    """Writes all sections, checks what was written and declares it with a manifest (section, n_rows, fingerprint, version). A
    release that fails a check keeps its files and gets no manifest, so nobody takes it for one."""
    missing = [s for s in SECTIONS if s not in sections]
    if missing:
        raise BrokenRelease(f"{version}: sections missing: {', '.join(missing)}")

    def checked(written: dict[str, DataFrame]) -> None:
        first = violations(written, flags, themes).limit(5).collect()
        if first:
            raise BrokenRelease(f"{version}: " + "; ".join(f"{r['check']} {r['key']} ({r['detail']})" for r in first))

    return sinks.write_release(sections, folder, version, checked)
