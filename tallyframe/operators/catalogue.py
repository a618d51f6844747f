"""Ballots that may become questions, and the questions' own tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import rules
from tallyframe.functions.dates import date_in_words
from tallyframe.functions.text import clean_title, law_key
from tallyframe.operators.temporal import newest
from tallyframe.params import DEFAULT, Params

NOT_DIVISIVE = "not_divisive"
ONE_SIDED = "no_tracked_party_on_each_side"
SAME_LAW = "same_law_voted_again"


def candidates(
    ballots: DataFrame, acts: DataFrame, by_party: DataFrame, tracked: list[int], p: Params = DEFAULT
) -> DataFrame:
    """(ballot_id, ballot_date, ext_id, law, minority_for, minority_of, reason); reason NULL means kept.

    Only final, coherent, open ballots without a confidence vote whose act has a title. The first failing rule names
    the reason. Of several ballots on one law the latest stays; on one day the smaller id.
    """
    open_ballots = ballots.filter(
        (F.col("term") == p.reference_term) & F.col("is_final") & F.col("coherent")
        & ~F.col("is_confidence") & ~F.col("is_secret")
    ).select("ballot_id", "ballot_date", "ext_id", "n_for", "n_against")
    titled = acts.filter(F.col("act_title").isNotNull()).select("ballot_id", "act_title")
    counts = [F.col(c) for c in ("n_for", "n_against", "n_abstain")]
    sides = (
        by_party.withColumn(
            "_o", F.when(F.col("party_id").isin(*tracked), rules.orientation_of_counts(*counts, p))
        )
        .groupBy("ballot_id")
        .agg(
            F.coalesce(F.bool_or(F.col("_o") == 1), F.lit(False)).alias("_pro"),
            F.coalesce(F.bool_or(F.col("_o") == -1), F.lit(False)).alias("_con"),
        )
    )
    rows = open_ballots.join(titled, "ballot_id").join(sides, "ballot_id")
    fav, con = F.col("n_for"), F.col("n_against")
    early = F.when(~rules.is_divisive(fav, con, p), NOT_DIVISIVE).when(~(F.col("_pro") & F.col("_con")), ONE_SIDED)
    judged = rows.withColumn("_early", early).withColumn("law", law_key(clean_title(F.col("act_title"))))
    same_law = Window.partitionBy("law", F.col("_early").isNull()).orderBy(F.col("ballot_date").desc(), "ext_id")
    again = F.when(F.row_number().over(same_law) > 1, SAME_LAW)
    return judged.select(
        "ballot_id", "ballot_date", "ext_id", "law", F.least(fav, con).alias("minority_for"),
        (fav + con).alias("minority_of"), F.coalesce("_early", again).alias("reason"),
    )


def discard_tally(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


def balanced_selection(statements: DataFrame, themes: list[str], p: Params = DEFAULT) -> DataFrame:
    """The same number k of statements per theme: k = min(per_theme, the poorest theme).

    Preference: larger minority share, then newer, then id. A text seen before (in theme order, then preference) is
    dropped; empty texts are all kept. `themes` is the fixed list of themes.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in themes]), F.col("theme"))
    text = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    prefer = [F.col("minority").desc(), F.col("ballot_date").desc(), F.col("statement_id")]
    ranked = statements.filter(F.col("theme").isin(*themes)).withColumn("_text", text).withColumn("_theme", place)
    empty = F.col("_text") == ""
    unique = newest(ranked.filter(~empty), ["_text"], [F.col("_theme"), *prefer]).unionByName(ranked.filter(empty))
    sizes = unique.groupBy("theme").agg(F.count("*").alias("n"))
    poorest = sizes.agg(F.when(F.count("*") == len(themes), F.min("n")).otherwise(0).alias("k")).scalar()
    return newest(unique, ["theme"], prefer, rank=p.per_theme).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("theme").orderBy(*prefer))
    ).filter(F.col("_rn") <= poorest).select(*statements.columns)


def latest_on_distinct_themes(statements: DataFrame, n: int = 3) -> DataFrame:
    """The n most recent statements, one per theme."""
    best = newest(statements, ["theme"], [F.col("ballot_date").desc(), F.col("statement_id")])
    return best.orderBy(F.col("ballot_date").desc(), F.col("statement_id")).limit(n)


def statement_tests(statements: DataFrame, answers: DataFrame) -> DataFrame:
    """(statement_id, theme_ok, sensitivity_ok, polarity_ok, passed).

    answers: (statement_id, role, answer, theme). Sensitivity: every original and variant is agreed with. Polarity:
    every opposite is rejected. A role without answers passes, as a universal statement over nothing does.
    """
    role, answer = F.col("role"), F.col("answer")
    judged = answers.groupBy("statement_id").agg(
        F.max("answer_theme").alias("_theme"),
        F.coalesce(F.bool_and(F.when(role.isin("statement", "variant"), answer == "agree")), F.lit(True)).alias(
            "sensitivity_ok"
        ),
        F.coalesce(F.bool_and(F.when(role == "opposite", answer == "against")), F.lit(True)).alias("polarity_ok"),
    )
    flags = statements.join(judged, "statement_id").withColumn("theme_ok", F.col("theme") == F.col("_theme"))
    passed = F.col("theme_ok") & F.col("sensitivity_ok") & F.col("polarity_ok")
    return flags.select("statement_id", "theme", "theme_ok", "sensitivity_ok", "polarity_ok", passed.alias("passed"))


def catalogue_report(tests: DataFrame) -> DataFrame:
    """One row: verified, passed and failures per test."""
    return tests.agg(
        F.count("*").alias("verified"), F.count_if("passed").alias("passed"),
        F.count_if(~F.col("theme_ok")).alias("theme_failed"),
        F.count_if(~F.col("sensitivity_ok")).alias("sensitivity_failed"),
        F.count_if(~F.col("polarity_ok")).alias("polarity_failed"),
    )


def full_report(judged: DataFrame, generated: DataFrame, tests: DataFrame, exclusions: DataFrame, themes: list[str]) -> DataFrame:
    """The catalogue report as rows (part, name, n): candidates and what the data discarded, by reason; what was generated,
    discarded by the model, verified and excluded by hand; tests passed and failed of what is left; passed statements of
    every theme, zero included.

    judged: reason (NULL: a candidate). generated: statement_id, discard. tests: as `statement_tests` gives them, with the ballot_id. exclusions:
    ballot_id, reason (without one it does not count).
    """
    def rows(df: DataFrame, part: str, **counts: Column) -> DataFrame:
        one = df.agg(*[c.alias(n) for n, c in counts.items()])
        return one.unpivot([], list(counts), "name", "n").select(F.lit(part).alias("part"), "name", "n")

    every = F.count(F.lit(1))
    left = without_excluded(tests, exclusions)
    counts = left.agg(*[F.count_if(F.col("passed") & (F.col("theme") == t)).alias(t) for t in themes])
    discarded = judged.filter(F.col("reason").isNotNull()).groupBy(F.col("reason").alias("name")).agg(every.alias("n"))
    flags = F.coalesce("discard", F.lit(False))
    return (
        rows(judged, "data", candidates=F.count_if(F.col("reason").isNull()))
        .unionByName(discarded.select(F.lit("discarded_by_data").alias("part"), "name", "n"))
        .unionByName(rows(generated, "model", generated=F.count_if(~flags), discarded=F.count_if(flags)))
        .unionByName(rows(tests, "statements", verified=every))
        .unionByName(rows(left, "statements", left=every, passed=F.count_if("passed")))
        .unionByName(rows(left, "failed", theme=F.count_if(~F.col("theme_ok")), sensitivity=F.count_if(~F.col("sensitivity_ok")), polarity=F.count_if(~F.col("polarity_ok"))))
        .unionByName(counts.unpivot([], themes, "name", "n").select(F.lit("passed_per_theme").alias("part"), "name", "n"))
    )


def passed_per_theme(tests: DataFrame, themes: list[str]) -> DataFrame:
    """Passed statements of every listed theme, zero included, and whether all themes have the same number."""
    counts = tests.agg(*[F.count_if(F.col("passed") & (F.col("theme") == t)).alias(t) for t in themes])
    values = [F.col(t) for t in themes]
    level = counts.withColumn("all_equal", F.greatest(*values) == F.least(*values))
    return level.unpivot("all_equal", themes, "theme", "n")


def without_excluded(statements: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drops manually excluded ballots; an exclusion without a reason does not count (see quality.reasonless)."""
    reasoned = exclusions.filter(F.trim(F.coalesce("reason", F.lit(""))) != "")
    return statements.join(reasoned.select("ballot_id"), "ballot_id", "left_anti")


def usable_answers(candidates_: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers matched to candidates by external id; discarded or incomplete answers are left out."""
    complete = answers.filter(~F.coalesce("discard", F.lit(False)))
    for c in ("theme", "statement", "opposite"):
        complete = complete.filter(F.coalesce(c, F.lit("")) != "")
    return candidates_.select("ballot_id", "ext_id").join(complete, "ext_id")


def statement_key(chamber: Column, ext_id: Column) -> Column:
    """Identifier of a statement from the ballot it comes from."""
    return F.concat(F.lit("e-"), F.replace(F.lower(F.concat_ws("-", chamber, ext_id)), F.lit("_"), F.lit("-")))


# How the origin of a statement is told.
CHAMBER_PLACE = {"lower": "alla Camera", "upper": "al Senato"}
VOTED = ("approvata", "respinta", "votata")


def origin_fact(chamber: Column, day: Column, approved: Column) -> Column:
    """The vote a statement comes from, in a sentence without figures."""
    place = F.when(chamber == "lower", CHAMBER_PLACE["lower"]).otherwise(CHAMBER_PLACE["upper"])
    outcome = F.when(approved, VOTED[0]).when(~approved, VOTED[1]).otherwise(VOTED[2])
    return F.concat(F.lit("Se n'è votato "), place, F.lit(" il "), date_in_words(day), F.lit(": la legge è stata "), outcome, F.lit("."))


def statement_records(candidates_: DataFrame, answers: DataFrame, tests: DataFrame, model: str, prompt: str, version: int = 1) -> DataFrame:
    """Statements as they are filed, one per candidate with an answer and tests: id, version, text, theme, status, context
    (fact, pro, con), origin (the ballot, its act and day, direction, and what generated the text) and tests.

    candidates_: ballot_id, chamber, term, ext_id, ballot_date, approved, act_ref, act_title, minority. answers: ballot_id,
    statement, theme, pro, con. tests: ballot_id, theme_ok, sensitivity_ok, polarity_ok.
    """
    joined = candidates_.join(answers, "ballot_id").join(tests.select("ballot_id", "theme_ok", "sensitivity_ok", "polarity_ok"), "ballot_id")
    return joined.select(
        statement_key(F.col("chamber"), F.col("ext_id")).alias("id"), F.lit(version).alias("version"), F.trim("statement").alias("text"), "theme", F.lit("active").alias("status"),
        F.struct(origin_fact(F.col("chamber"), F.col("ballot_date"), F.col("approved")).alias("fact"), F.trim("pro").alias("pro"), F.trim("con").alias("con")).alias("context"),
        F.struct(
            "chamber", "term", "ext_id", "act_ref", F.col("ballot_date").alias("date"), F.lit(1).alias("direction"),
            F.struct(F.lit(model).alias("model"), F.lit(prompt).alias("prompt"), F.sha2("act_title", 256).alias("input_sha")).alias("generation"),
        ).alias("origin"),
        F.struct(F.col("minority"), F.col("theme_ok").alias("theme"), F.col("sensitivity_ok").alias("sensitivity"), F.col("polarity_ok").alias("polarity")).alias("tests"),
    )


def import_readiness(ballots: DataFrame, chambers: list[str], today, days: int = 30) -> DataFrame:
    """(chamber, last_ballot, ready) of every expected chamber: present and not older than `days`."""
    latest = ballots.agg(*[F.max(F.when(F.col("chamber") == c, F.col("ballot_date"))).alias(c) for c in chambers])
    rows = latest.unpivot([], chambers, "chamber", "last_ballot")
    return rows.withColumn("ready", F.coalesce(F.datediff(F.lit(today), "last_ballot") <= days, F.lit(False)))
