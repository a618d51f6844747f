from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import dates, rules
from tallyframe.operators import affinity as A
from tallyframe.operators import catalogue as C
from tallyframe.operators import positions as P
from tallyframe.operators import readings as R
from tallyframe.operators import series as S
from tallyframe.params import DEFAULT


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lits(*values):
    return [F.lit(v) for v in values]


@pytest.mark.parametrize("counts, expected", [
    ((3, 1, 0), 1), ((1, 3, 0), -1), ((2, 1, 0), 0), ((2, 1, 1), 0), ((3, 0, 3), 1), ((1, 1, 0), None), ((0, 0, 0), None),
    ((0, 0, 3), 0),
])
def test_orientation_counts_the_exact_half(spark, counts, expected):
    assert one(spark, rules.orientation_of_counts(*lits(*counts))) == expected


def test_orientation_is_symmetric(spark):
    pairs = spark.range(8).selectExpr("id AS f").join(spark.range(8).selectExpr("id AS c"))
    f, c, a = F.col("f"), F.col("c"), F.lit(1)
    bad = pairs.filter(
        ~rules.orientation_of_counts(f, c, a).eqNullSafe(-rules.orientation_of_counts(c, f, a))
    )
    assert bad.count() == 0


@pytest.mark.parametrize("num, den, expected", [(1, 2, 1), (-1, 2, -1), (3, 2, 2), (-3, 2, -2), (1, 3, 0), (2, 3, 1), (0, 5, 0)])
def test_halves_round_away_from_zero(spark, num, den, expected):
    assert one(spark, rules.round_half_away(*lits(num, den))) == expected


@pytest.mark.parametrize("counts, expected", [((2, 1, 0), "for"), ((1, 2, 0), "against"), ((0, 0, 1), "abstain"), ((2, 2, 0), None), ((0, 0, 0), None)])
def test_prevailing(spark, counts, expected):
    assert one(spark, rules.prevailing(*lits(*counts))) == expected


@pytest.mark.parametrize("counts, expected", [((9, 1, 0), True), ((8, 1, 1), False), ((0, 0, 0), False)])
def test_united(spark, counts, expected):
    assert one(spark, rules.is_united(*lits(*counts))) is expected


def test_wilson_without_cases(spark):
    low, high = rules.wilson(*lits(0, 0))
    assert (one(spark, low), one(spark, high)) == (0.0, 1.0)


@pytest.mark.parametrize("n, d, words, figure", [
    (96, 100, "almost all", "96%"), (95, 100, "more than two in three", "95%"), (1, 2, "more than a third", "1"),
    (0, 0, "less than a quarter", "0"), (1, 40, "less than a quarter", "3%"),
])
def test_words_and_gate(spark, n, d, words, figure):
    assert one(spark, rules.share_in_words(*lits(n, d))) == words
    assert one(spark, rules.gated_percent(*lits(n, d))) == figure


def test_rule_language_rejects_nonsense(spark):
    with pytest.raises((KeyError, ValueError)):
        rules.first_sentence([("share ~ 1", "a"), (None, "b")], *lits(1, 2))
    with pytest.raises(ValueError):
        rules.first_sentence([("share < 1", "a")], *lits(1, 2))


def test_period_ends_are_inclusive(spark):
    day = F.lit(date(2024, 3, 1))
    assert one(spark, dates.valid_at(day, F.lit(date(2024, 1, 1)), F.lit(date(2024, 3, 1))))
    assert one(spark, dates.valid_at(day, F.lit(date(2024, 3, 1)), F.lit(None).cast("date")))
    assert one(spark, dates.active_at(day, F.lit(None).cast("date"), F.lit(None).cast("date")))
    assert not one(spark, dates.valid_at(day, F.lit(date(2024, 3, 2)), F.lit(None).cast("date")))


@pytest.mark.parametrize("text, expected", [
    ("2026-10-06T10:00:00Z", "2026-10-06 10:00:00"), ("2026-10-06T12:00:00+02:00", "2026-10-06 10:00:00"),
    ("Tue, 06 Oct 2026 10:00:00 GMT", "2026-10-06 10:00:00"), ("20261006T100000Z", "2026-10-06 10:00:00"),
    ("2026-10-06", "2026-10-06 00:00:00"), ("yesterday", None),
])
def test_instants(spark, text, expected):
    got = one(spark, dates.instant(F.lit(text)))
    assert (str(got) if got else None) == expected


def evidence(spark, votes):
    return spark.createDataFrame(
        [("p", "s", f"b{i}", date(2024, 1, 1 + i), term, o, o) for i, (term, o) in enumerate(votes)],
        "subject_id string, statement_id string, ballot_id string, ballot_date date, term int, vote int, orientation int",
    )


@pytest.mark.parametrize("votes, value, status, confidence", [
    ([(19, 1)], 2, "documented", "full"), ([(19, 1), (19, 0)], 1, "documented", "full"),
    ([(19, 1), (19, -1)], 0, "divergent", "full"), ([(19, 1), (19, 1), (19, -1)], 1, "divergent", "full"),
    ([(18, -1), (17, 1)], 2, "documented", "reduced"), ([(18, 1), (19, -1)], -2, "documented", "full"),
])
def test_positions(spark, votes, value, status, confidence):
    row = P.position_of(evidence(spark, votes)).first()
    assert (row.value, row.status, row.confidence) == (value, status, confidence)


def test_later_terms_are_never_used(spark):
    assert P.position_of(evidence(spark, [(20, 1)])).count() == 0


def test_empty_series_quarters_are_filled(spark):
    df = spark.createDataFrame(
        [("a", date(2024, 1, 1), 1), ("a", date(2024, 10, 1), 2), ("b", date(2024, 4, 1), 3)], "party_id string, quarter date, n int"
    )
    got = sorted(tuple(r) for r in S.fill_quarters(df, "party_id", ["n"]).collect())
    assert [n for p, _, n in got if p == "a"] == [1, 0, 0, 2]
    assert [n for p, _, n in got if p == "b"] == [0, 3, 0, 0]


def test_too_few_then_verdict(spark):
    series = [("a", "m", date(2020 + i // 4, 1 + 3 * (i % 4), 1), 9 if i > 3 else 1, 10) for i in range(8)]
    df = spark.createDataFrame(series, "party_id string, metric string, quarter date, n int, d int")
    assert S.year_over_year(df).first().verdict == "more"
    assert S.year_over_year(df.filter("quarter > '2020-02-01'")).first().verdict == "too_few"


def test_ties_are_all_named_and_shares_are_exact(spark):
    df = spark.createDataFrame(
        [("a", "m", 10, 30), ("b", "m", 20, 60), ("c", "m", 9, 30), ("d", "m", 29, 29)], "subject_id string, metric string, n bigint, d bigint"
    )
    row = R.extremes(df, {"m": "max"}).first()
    assert (row.names, row.winners) == ("a e b", 2)
    assert R.extremes(df.filter("subject_id = 'a'"), {"m": "max"}).count() == 0


def test_balanced_selection_is_limited_by_the_poorest_theme(spark):
    made = [(f"s{i}", date(2024, 1, 1 + i), f"t{i % 2}", f"text {i}", 0.1 * i) for i in range(7)]
    made.append(("dup", date(2024, 2, 1), "t1", "TEXT  0", 0.9))
    df = spark.createDataFrame(made, "statement_id string, ballot_date date, theme string, text string, minority double")
    picked = C.balanced_selection(df, ["t0", "t1"])
    assert {r.theme: r.n for r in picked.groupBy("theme").agg(F.count("*").alias("n")).collect()} == {"t0": 3, "t1": 3}
    assert picked.filter("statement_id = 'dup'").count() == 0
    assert C.balanced_selection(df, ["t0", "t1", "t2"]).count() == 0


ANSWERS = "respondent_id string, statement_id string, value int, important boolean"
POSITIONS = "subject_id string, statement_id string, value int"
LEVELS = st.sampled_from([-2, -1, 0, 1, 2])


def score(spark, answers, positions):
    a = spark.createDataFrame([("r", f"s{i}", v, w) for i, (v, w) in enumerate(answers)], ANSWERS)
    p = spark.createDataFrame([("x", f"s{i}", v) for i, v in enumerate(positions)], POSITIONS)
    found = A.affinity_scores(a, p).collect()
    return found[0].affinity if found else None


@pytest.mark.parametrize("answers, positions, expected", [
    ([(2, False), (-2, False)], [2, 2], 50), ([(2, True), (-2, False)], [2, 2], 67), ([(1, False)], [-1], 50), ([(2, False)], [None], None),
    ([(0, False)], [2], None), ([(2, False), (1, False)], [1, None], 75),
])
def test_affinity_by_hand(spark, answers, positions, expected):
    assert score(spark, answers, positions) == expected


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(LEVELS, st.booleans(), st.one_of(st.none(), LEVELS)), min_size=1, max_size=6))
def test_affinity_is_symmetric_and_bounded(spark, cases):
    answers, positions = [(u, w) for u, w, _ in cases], [p for _, _, p in cases]
    there = score(spark, answers, positions)
    back = score(spark, [(-u, w) for u, w in answers], [None if p is None else -p for p in positions])
    assert there == back
    assert there is None or 0 <= there <= 100


def test_leaders_within_the_margin(spark):
    scores = spark.createDataFrame([("r", "b", 49), ("r", "a", 46), ("r", "c", 45), ("r", "d", None)], "respondent_id string, subject_id string, affinity int")
    got = {r.subject_id: (r.place, r.leader, r.nobody) for r in A.ranked(scores, replace(DEFAULT)).collect()}
    assert got == {"b": (1, True, True), "a": (2, True, True), "c": (3, False, True), "d": (4, False, True)}
