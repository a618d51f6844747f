"""Positions of subjects on statements, from votes only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import rules
from tallyframe.functions.dates import date_in_words
from tallyframe.params import DEFAULT, Params


def party_evidence(anchors: DataFrame, by_party: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Evidence rows of parties on anchored ballots; a party below the minimum of voters gives none."""
    counts = [F.col(c) for c in ("n_for", "n_against", "n_abstain")]
    oriented = by_party.withColumn("_o", rules.orientation_of_counts(*counts, p)).filter(F.col("_o").isNotNull())
    return _evidence(anchors, oriented.withColumn("subject_id", F.concat(F.lit("party-"), F.col("party_id").cast("string"))))


def person_evidence(anchors: DataFrame, person_votes: DataFrame) -> DataFrame:
    oriented = person_votes.withColumn("_o", rules.orientation_of_expression(F.col("expression")))
    return _evidence(anchors, oriented.filter(F.col("_o").isNotNull()))


def _evidence(anchors: DataFrame, oriented: DataFrame) -> DataFrame:
    return anchors.join(oriented.select("ballot_id", "subject_id", "_o"), "ballot_id").select(
        "subject_id", "statement_id", "ballot_id", "ballot_date", "term", F.col("_o").alias("vote"),
        (F.col("_o") * F.col("direction")).alias("orientation"),
    )


def position_of(evidence: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(subject_id, statement_id, value, status, confidence, votes, valid_from) where there is any evidence.

    Votes of the reference term: twice their mean, rounded half away from zero; 'divergent' when they point both ways.
    Without any: the latest earlier vote, with reduced confidence. Later terms are never used.
    """
    current = F.col("term") == p.reference_term
    points = F.col("orientation")
    earlier = F.when(F.col("term") < p.reference_term, F.struct("ballot_date", "ballot_id", "orientation"))
    sums = evidence.groupBy("subject_id", "statement_id").agg(
        F.count_if(current).alias("votes"),
        F.coalesce(F.sum(F.when(current, points)), F.lit(0)).alias("_sum"),
        F.coalesce(F.bool_or(current & (points == 1)), F.lit(False)).alias("_pro"),
        F.coalesce(F.bool_or(current & (points == -1)), F.lit(False)).alias("_con"),
        F.max(F.when(current, F.col("ballot_date"))).alias("_since"),
        F.max(earlier).alias("_last"),
    )
    now = F.col("votes") > 0
    mean = rules.round_half_away(2 * F.col("_sum"), F.col("votes"))
    clipped = F.greatest(F.lit(-2), F.least(F.lit(2), mean))
    used = sums.filter(now | F.col("_last").isNotNull())
    return used.select(
        "subject_id", "statement_id",
        F.when(now, clipped).otherwise(2 * F.col("_last.orientation")).cast("int").alias("value"),
        F.when(now & F.col("_pro") & F.col("_con"), "divergent").otherwise("documented").alias("status"),
        F.when(now, "full").otherwise("reduced").alias("confidence"),
        F.when(now, F.col("votes")).otherwise(1).alias("votes"),
        F.when(now, F.col("_since")).otherwise(F.col("_last.ballot_date")).alias("valid_from"),
    )


def subject_grid(subjects: DataFrame, statements: DataFrame) -> DataFrame:
    """Every subject with every statement. The catalogue is a short published list, so it travels as one array."""
    ids = statements.agg(F.array_sort(F.collect_list("statement_id")).alias("ids")).scalar()
    return subjects.select("subject_id", F.explode(ids).alias("statement_id"))


def positions(subjects: DataFrame, statements: DataFrame, evidence: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per subject and statement; no evidence gives NULL and 'not_documented'."""
    known = position_of(evidence, p)
    return subject_grid(subjects, statements).join(known, ["subject_id", "statement_id"], "left").select(
        "subject_id", "statement_id", "value", F.coalesce("status", F.lit("not_documented")).alias("status"),
        "confidence", F.coalesce("votes", F.lit(0)).alias("votes"), "valid_from",
    )


# Sentences shown next to a vote, for parties and for people.
PARTY_SENTENCES = {1: "Ha votato a favore", -1: "Ha votato contro", 0: "Si è diviso"}
PERSON_SENTENCES = {1: "Ha votato a favore", -1: "Ha votato contro", 0: "Si è astenuto"}
CHAMBERS = {"lower": "Camera", "upper": "Senato"}


def shorten(text: Column, size: int = 120) -> Column:
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(squeezed, 1, size - 1)), F.lit("…"))
    return F.when(F.length(squeezed) > size, cut).otherwise(squeezed)


def evidence_text(orientation: Column, title: Column, sentences: dict[int, str]) -> Column:
    said = F.when(orientation == 1, sentences[1]).when(orientation == -1, sentences[-1]).otherwise(sentences[0])
    return shorten(F.when(F.coalesce(title, F.lit("")) == "", said).otherwise(F.concat(said, F.lit(": "), title)))


def when_text(chamber: Column, day: Column) -> Column:
    name = F.when(chamber == "lower", CHAMBERS["lower"]).otherwise(CHAMBERS["upper"])
    return F.concat(name, F.lit(", "), date_in_words(day))
