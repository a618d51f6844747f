"""Checks. Each returns a violations table (check, key, detail) or a small profile; none raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def failing(df: DataFrame, check: str, keys: list[str], bad: Column, detail: Column) -> DataFrame:
    """Rows for which `bad` is true."""
    return df.filter(bad).select(F.lit(check).alias("check"), _key(keys).alias("key"), detail.cast("string").alias("detail"))


def period_order(periods: DataFrame, keys: list[str]) -> DataFrame:
    return failing(periods, "period_order", keys, F.col("valid_to") < F.col("valid_from"), F.col("valid_to"))


def duplicate_keys(df: DataFrame, keys: list[str], check: str = "duplicate_key") -> DataFrame:
    """Counted by partial aggregation: a key repeated a billion times is one row per task."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return failing(counted, check, keys, F.col("_n") > 1, F.col("_n"))


def outside_domain(df: DataFrame, column: str, allowed: list[str], keys: list[str]) -> DataFrame:
    bad = F.col(column).isNull() | ~F.col(column).isin(*allowed)
    return failing(df, f"domain_{column}", keys, bad, F.coalesce(F.col(column).cast("string"), F.lit("NULL")))


def negative(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    lowest = F.least(*[F.col(c) for c in columns])
    return failing(df, "negative_count", keys, lowest < 0, lowest)


def orphans(df: DataFrame, parents: DataFrame, keys: list[str], check: str) -> DataFrame:
    """Keys without a parent row, with how many rows carry them. Distinct keys meet the parents, not the rows."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    lonely = counted.join(parents.select(*keys), keys, "left_anti")
    return failing(lonely, check, keys, F.lit(True), F.col("_n"))


def position_nullability(positions: DataFrame) -> DataFrame:
    """A value is NULL exactly when the status says so, and exactly when confidence is NULL."""
    keys = ["subject_id", "statement_id"]
    empty = F.col("value").isNull()
    status = failing(
        positions, "value_vs_status", keys, empty != (F.col("status") == "not_documented"), F.col("status")
    )
    confidence = failing(
        positions, "value_vs_confidence", keys, empty != F.col("confidence").isNull(),
        F.coalesce("confidence", F.lit("NULL")),
    )
    return status.unionByName(confidence)


def membership_targets(memberships: DataFrame, keys: list[str]) -> DataFrame:
    """Exactly the target that the kind names is set."""
    targets = {"group": "group_id", "party": "party_id"}
    wrong = F.lit(False)
    for kind, column in targets.items():
        wrong = wrong | ((F.col("kind") == kind) != F.col(column).isNotNull())
    return failing(memberships, "membership_target", [*keys, "kind"], wrong, F.col("kind"))


def retention_rules(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Level C text has an expiry; a text with a clearing time is gone."""
    text = F.col("text").isNotNull()
    unlimited = failing(
        documents, "text_without_expiry", keys, (F.col("level") == "C") & text & F.col("text_expires_at").isNull(),
        F.col("level"),
    )
    kept = failing(
        documents, "cleared_text_present", keys, F.col("text_cleared_at").isNotNull() & text, F.col("text_cleared_at")
    )
    return unlimited.unionByName(kept)


# The shape of identifiers and addresses in the registries.
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
WEB = "^https?://"
PREVIEW = "^https://t\\.me/s/[A-Za-z0-9_]+$"


def bad_shape(df: DataFrame, column: str, pattern: str, keys: list[str]) -> DataFrame:
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return failing(df, f"shape_{column}", keys, ~value.rlike(pattern), value)


def source_rules(sources: DataFrame) -> DataFrame:
    """Rules on news sources: source, kind, channel, level, url, link_pattern, party, person, orientation."""
    press = F.col("kind").isin("outlet", "agency")
    rules = {
        "site_needs_link": (F.col("channel") == "site") & F.col("link_pattern").isNull(),
        "preview_address": (F.col("channel") == "preview") & ~F.col("url").rlike(PREVIEW),
        "orientation_iff_press": press != F.col("orientation").isNotNull(),
        "level_c_iff_press": press != (F.col("level") == "C"),
        "party_missing": (F.col("kind") == "party") & F.col("party").isNull(),
        "person_missing": (F.col("kind") == "politician") & F.col("person").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return sources.select(F.explode(broken).alias("check"), F.col("source").alias("key"), F.col("kind").alias("detail"))


def unequal_themes(statements: DataFrame) -> DataFrame:
    """Active statements per theme when the themes do not all have the same number."""
    counts = statements.filter(F.col("status") == "active").groupBy("theme").agg(F.count("*").alias("n"))
    spread = counts.agg((F.max("n") > F.min("n")).alias("s")).scalar()
    return failing(counts, "themes_unequal", ["theme"], spread, F.col("n"))


def shared_forms(aliases: DataFrame) -> DataFrame:
    """Name forms, letter case aside, that belong to more than one person."""
    owners = aliases.groupBy(F.lower("form").alias("form")).agg(F.min("slug").alias("_a"), F.max("slug").alias("_b"))
    return failing(owners, "form_of_two_people", ["form"], F.col("_a") != F.col("_b"), F.concat_ws(",", "_a", "_b"))


def outlet_balance(sources: DataFrame, orientations: list[str]) -> DataFrame:
    """Active outlets per listed orientation (zero included) when they are not all equal, or one has none."""
    kept = sources.filter((F.col("kind") == "outlet") & F.coalesce("active", F.lit(True)))
    counts = kept.agg(*[F.count_if(F.col("orientation") == o).alias(o) for o in orientations])
    values = [F.col(o) for o in orientations]
    uneven = (F.greatest(*values) != F.least(*values)) | (F.least(*values) == 0)
    rows = counts.withColumn("_bad", uneven).unpivot("_bad", orientations, "orientation", "n")
    return failing(rows, "outlet_balance", ["orientation"], F.col("_bad"), F.col("n"))


def missing_coverage(required: DataFrame, covered: DataFrame, keys: list[str], check: str) -> DataFrame:
    gaps = required.select(*keys).distinct().join(covered.select(*keys), keys, "left_anti")
    return failing(gaps, check, keys, F.lit(True), F.lit("missing"))


def unconfirmed(df: DataFrame, what: str, keys: list[str], unsure: Column) -> DataFrame:
    """Facts still to be confirmed: listed, never blocking."""
    return failing(df, "unconfirmed", keys, unsure, F.lit(what))


def reasonless(exclusions: DataFrame, keys: list[str]) -> DataFrame:
    return failing(exclusions, "exclusion_without_reason", keys, F.trim(F.coalesce("reason", F.lit(""))) == "", F.lit(""))


def series_shape(series: DataFrame) -> DataFrame:
    """n above d, and series that do not cover every quarter of the release."""
    over = failing(series, "n_over_d", ["party_id", "metric", "quarter"], F.col("n") > F.col("d"), F.col("n"))
    quarters = series.agg(F.count_distinct("quarter").alias("q")).scalar()
    lengths = series.groupBy("party_id", "metric").agg(F.count("*").alias("_len"))
    return over.unionByName(failing(lengths, "series_length", ["party_id", "metric"], F.col("_len") != quarters, F.col("_len")))


def seat_sums(seats: DataFrame) -> DataFrame:
    """Chambers whose holders do not add up to the total."""
    sums = seats.groupBy("chamber").agg(
        F.sum(F.when(F.col("holder") == "total", F.col("seats")).otherwise(0)).alias("_t"),
        F.sum(F.when(F.col("holder") != "total", F.col("seats")).otherwise(0)).alias("_s"),
    )
    return failing(sums, "seats_vs_total", ["chamber"], F.col("_t") != F.col("_s"), F.col("_s") - F.col("_t"))


def programme_sums(metrics: DataFrame, themes: list[str]) -> DataFrame:
    """Programmes with more themed than counted promises, or more precise ones than promises."""
    keys = ["party_id", "document_id"]
    themed = sum((F.col(t) for t in themes[1:]), F.col(themes[0]))
    return failing(metrics, "themes_over_promises", keys, themed > F.col("promises"), themed).unionByName(
        failing(metrics, "precise_over_promises", keys, F.col("precise") > F.col("promises"), F.col("precise"))
    )


def duplicate_factor(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys, rows per key in hundredths."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return sizes.agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_distinct")).withColumn(
        "per_key_hundredths", F.floor(100 * F.col("n_rows") / F.col("n_distinct"))
    )


def groups_without_party(counts: DataFrame, group_party: DataFrame) -> DataFrame:
    """Groups that voted and have no party link at all, with their number of ballots."""
    met = counts.filter(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.count("*").alias("n_ballots"))
    return met.join(group_party.select("group_id"), "group_id", "left_anti")


def votes_outside_membership(votes: DataFrame, memberships: DataFrame) -> DataFrame:
    """Votes cast on a day on which the person belonged to no group, counted per person."""
    from tallyframe.operators.temporal import fold_periods, valid_entries

    groups = memberships.filter(F.col("kind") == "group")
    folded = fold_periods(groups, "person_id", "group_id", "_periods")
    inside = F.coalesce(F.size(valid_entries(F.col("_periods"), F.col("on_date"))) > 0, F.lit(False))
    outside = votes.join(folded, "person_id", "left").filter(~inside)
    return outside.groupBy("person_id").agg(F.count("*").alias("n_votes"))


def import_gate(checked: DataFrame) -> DataFrame:
    """One row: ballots, incoherent ones, the number tolerated (10 or one in a hundred) and whether the import fails."""
    sums = checked.agg(F.count("*").alias("ballots"), F.count_if(~F.col("coherent")).alias("incoherent"))
    allowed = F.greatest(F.lit(10), F.floor(F.col("ballots") / 100))
    return sums.withColumn("tolerated", allowed).withColumn("failed", F.col("incoherent") > F.col("tolerated"))


def freshness(ballots: DataFrame) -> DataFrame:
    """Latest ballot per chamber, and how far all chambers reach together (the slowest one)."""
    latest = ballots.groupBy("chamber").agg(F.max("ballot_date").alias("last_ballot"))
    return latest.withColumn("votes_until", latest.select(F.min("last_ballot")).scalar())


def out_of_range(df: DataFrame, column: str, low: float, high: float, keys: list[str]) -> DataFrame:
    """Values outside low to high, both allowed; a missing value is outside."""
    value = F.col(column)
    return failing(df, f"range_{column}", keys, F.coalesce(~value.between(low, high), F.lit(True)), F.coalesce(value.cast("string"), F.lit("missing")))


def bad_length(df: DataFrame, column: str, low: int, high: int, keys: list[str]) -> DataFrame:
    """Texts, or lists, of fewer than `low` or more than `high` characters or members; NULL has none."""
    kind = dict(df.dtypes)[column]
    size = F.coalesce(F.size(column) if kind.startswith("array") else F.length(column), F.lit(0))
    return failing(df, f"length_{column}", keys, ~F.greatest(size, F.lit(0)).between(low, high), F.greatest(size, F.lit(0)))


def scale_of_levels(levels: DataFrame, key: str, order: str, value: str, size: int = 5) -> DataFrame:
    """Scales that do not have `size` levels, or whose values do not rise from level to level."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    scale = levels.groupBy(key).agg(rows.alias("_r"))
    rising = F.forall(F.sequence(F.lit(1), F.size("_r") - 1), lambda i: F.get("_r", i)["v"] > F.get("_r", i - 1)["v"])
    return failing(scale, "scale_size", [key], F.size("_r") != size, F.size("_r")).unionByName(
        failing(scale, "scale_order", [key], (F.size("_r") > 1) & ~F.coalesce(rising, F.lit(False)), F.size("_r"))
    )


def last_rule_is_default(rules_: DataFrame, key: str, order: str, condition: str) -> DataFrame:
    """Rule lists whose last rule has a condition, or that have a rule without one before the last."""
    lists = rules_.groupBy(key).agg(
        F.max_by(F.col(condition).isNull(), order).alias("_last"), F.count_if(F.col(condition).isNull()).alias("_free")
    )
    bad = ~F.col("_last") | (F.col("_free") > 1)
    return failing(lists, "default_rule", [key], bad, F.col("_free"))


def verified_without_id(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Groups called verified that have no identifier of the source."""
    bare = F.trim(F.coalesce("ext_id", F.lit(""))) == ""
    return failing(groups, "verified_without_id", keys, (F.col("status") == "verified") & bare, F.col("status"))


def other_term(rows: DataFrame, keys: list[str], term: int) -> DataFrame:
    """Rows of another term than the one the rules refer to."""
    return failing(rows, "other_term", keys, ~F.col("term").eqNullSafe(F.lit(term)), F.coalesce(F.col("term").cast("string"), F.lit("missing")))
