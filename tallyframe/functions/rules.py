"""Threshold rules on counts. Comparisons are integer cross-multiplications: no floating point at a threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.params import DEFAULT, Params


def voters(n_for: Column, n_against: Column, n_abstain: Column) -> Column:
    return n_for + n_against + n_abstain


def prevailing(n_for: Column, n_against: Column, n_abstain: Column) -> Column:
    """The choice with most votes; NULL without votes or when the lead is shared."""
    top = F.greatest(n_for, n_against, n_abstain)
    at_top = sum((c == top).cast("int") for c in (n_for, n_against, n_abstain))
    choice = F.when(n_for == top, "for").when(n_against == top, "against").otherwise("abstain")
    return F.when((top > 0) & (at_top == 1), choice)


def is_united(n_for: Column, n_against: Column, n_abstain: Column, p: Params = DEFAULT) -> Column:
    num, den = p.united
    cast = voters(n_for, n_against, n_abstain)
    return (cast > 0) & (den * F.greatest(n_for, n_against, n_abstain) >= num * cast)


def orientation_of_expression(expression: Column) -> Column:
    """+1 / -1 / 0 for a vote that is evidence; NULL for absences, missions and the rest."""
    return F.when(expression == "for", 1).when(expression == "against", -1).when(expression == "abstain", 0)


def orientation_of_counts(n_for: Column, n_against: Column, n_abstain: Column, p: Params = DEFAULT) -> Column:
    """+1 / -1 when the lead reaches the majority share, 0 when split, NULL below the minimum of voters."""
    num, den = p.majority
    cast = voters(n_for, n_against, n_abstain)
    lead = den * (n_for - n_against)
    return F.when(
        (cast >= p.min_members) & (cast > 0),
        F.when(lead >= num * cast, 1).when(lead <= -num * cast, -1).otherwise(0),
    )


def round_half_away(num: Column, den: Column) -> Column:
    """num / den to the nearest integer, halves away from zero, in integers."""
    size = F.floor((2 * F.abs(num) + den) / (2 * den))
    return (F.sign(num) * size).cast("int")


def percent(points: Column, maximum: Column) -> Column:
    """Whole percent, halves up; NULL when there is nothing to compare."""
    return F.when(maximum > 0, F.floor((200 * points + maximum) / (2 * maximum)).cast("int"))


def minority_share(n_for: Column, n_against: Column) -> Column:
    expressed = n_for + n_against
    return F.coalesce(F.least(n_for, n_against) / F.nullif(expressed, F.lit(0)), F.lit(0.0))


def is_divisive(n_for: Column, n_against: Column, p: Params = DEFAULT) -> Column:
    num, den = p.minority
    return (n_for + n_against > 0) & (den * F.least(n_for, n_against) >= num * (n_for + n_against))


Z95 = 1.96


def wilson(n: Column, d: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval; (0, 1) when the denominator is zero."""
    size = F.nullif(d.cast("double"), F.lit(0.0))
    share = n / size
    scale = 1 + Z95**2 / size
    centre = share + Z95**2 / (2 * size)
    half = Z95 * F.sqrt(share * (1 - share) / size + Z95**2 / (4 * size * size))
    return F.coalesce((centre - half) / scale, F.lit(0.0)), F.coalesce((centre + half) / scale, F.lit(1.0))


def year_verdict(n_now: Column, d_now: Column, n_before: Column, d_before: Column, enough: Column) -> Column:
    """more / less only when the two intervals are disjoint; too_few when a year is below the minimum."""
    low_now, high_now = wilson(n_now, d_now)
    low_before, high_before = wilson(n_before, d_before)
    return (
        F.when(~enough, "too_few").when(low_now > high_before, "more").when(high_now < low_before, "less")
        .otherwise("same")
    )


def share_in_words(n: Column, d: Column) -> Column:
    """Six bands. 95, 66, 50, 33, 25 percent, all exclusive."""
    bands = (
        (95, "almost all"), (66, "more than two in three"), (50, "more than half"),
        (33, "more than a third"), (25, "more than a quarter"),
    )
    words = F.lit("less than a quarter")
    for limit, text in reversed(bands):
        words = F.when((d > 0) & (100 * n > limit * d), text).otherwise(words)
    return words


def gated_percent(n: Column, d: Column, p: Params = DEFAULT) -> Column:
    """'37%' at or above the minimum denominator, the bare count below it."""
    shown = F.floor((200 * n + d) / (2 * F.nullif(d, F.lit(0)))).cast("string")
    return F.when(d < p.min_denominator, n.cast("string")).otherwise(F.concat(shown, F.lit("%")))


def position_in_words(value: Column) -> Column:
    return F.when(value > 0, "Yes").when(value < 0, "No").when(value == 0, "Neither").otherwise("Unknown")


def area_of_role(role: Column) -> Column:
    """Opposition is tested before government; everything else is 'other'."""
    return (
        F.when(role.rlike("(?i)opposition"), "opposition").when(role.rlike("(?i)government"), "government")
        .otherwise("other")
    )


COMPARISONS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def condition(text: str, values: dict[str, Column]) -> Column:
    """'share <= 0.1' over named columns. Anything else is an error, never a default."""
    name, operator, number = text.split()
    return COMPARISONS[operator](values[name], F.lit(float(number)))


def first_sentence(rules: list[tuple[str | None, str]], n: Column, d: Column) -> Column:
    """Text of the first rule that holds, with {n} and {d} filled in. The last rule has no condition."""
    values = {"denominator": d, "share": F.when(d > 0, n / d).otherwise(0.0)}
    filled = [
        (rule, F.replace(F.replace(F.lit(text), F.lit("{n}"), n.cast("string")), F.lit("{d}"), d.cast("string")))
        for rule, text in rules
    ]
    if filled[-1][0] is not None:
        raise ValueError("the last rule must have no condition")
    out = filled[-1][1]
    for rule, text in reversed(filled[:-1]):
        out = F.when(condition(rule, values), text).otherwise(out)
    return out


def score_points(answer: Column, position: Column) -> Column:
    return 4 - F.abs(answer - position)


def answer_category(answer: Column, position: Column) -> Column:
    return (
        F.when(position.isNull(), "missing").when(position == 0, "neutral")
        .when(F.sign(position) == F.sign(answer), "agree").otherwise("disagree")
    )
