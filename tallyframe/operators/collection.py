"""Collected documents: which are new, which concern a tracked person, what may be kept and for how long."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text as X
from tallyframe.functions import urls as U
from tallyframe.operators.temporal import newest
from tallyframe.params import DEFAULT, Params
from tallyframe.storage import written


@dataclass(frozen=True)
class Names:
    """Name forms per tracked person, and the looser list of surnames (a hand-kept registry)."""

    forms: dict[str, list[str]]
    surnames: list[str] = field(default_factory=list)


def unique_by_content(documents: DataFrame, key: str, order: list[Column], *parts: Column) -> DataFrame:
    """Adds sha256 of the parts and keeps the first document of each content."""
    return newest(documents.withColumn("sha256", X.fingerprint(*parts)), ["sha256"], order)


def _all_texts(*texts: Column) -> Column:
    return X.clean_text(F.concat(*[F.concat(F.lit(" \n"), F.coalesce(t, F.lit(""))) for t in texts]))


def judge_documents(
    elements: DataFrame, seen: DataFrame, names: Names, now: Column, p: Params = DEFAULT, blank_is_text: bool = False
) -> DataFrame:
    """One row per listed element with its outcome and, for 'stored', the stored columns.

    elements: source, level, channel, ord, url, title, summary, text, published_at, reserved (page opposes mining; NULL: no).
    seen: url, and further columns of the elements if an address was seen in one place only; the same address in another
    place is then judged. NULLs are alike.
    blank_is_text: pages with an empty text have the same content; else such a page has no text, and its address stands for it.
    The texts are judged once and written; the rest starts from that table. An element is a row of it, numbered there: its
    source and place may be missing, which puts it last, or stand on several rows.

    Outcomes: 'seen' (address known), 'outside' (level C naming nobody tracked), 'duplicate' (address or content repeated),
    'stored'. Every listed element is judged; how many pages a crawler may fetch is not this operator's business.
    """
    order = [F.col(c).asc_nulls_last() for c in ("source", "ord", "_row")]
    listed = elements.withColumn("url", U.normal_url(F.col("url")))
    known = seen.distinct().select(*[F.col(c).alias(f"_{c}") for c in seen.columns], F.lit(True).alias("_seen"))
    listed = listed.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in seen.columns], "left")
    filtered = F.col("level") == "C"
    title_first = filtered & (F.col("channel") == "rss")
    early = _all_texts(F.col("title"), F.col("summary"))
    read = listed.withColumn(
        "_step",
        F.when(F.col("_seen"), "seen").when(
            title_first & ~X.names_anyone(early, names.forms, names.surnames), "outside"
        ),
    )
    # Texts are looked at only for what the address and the title let through.
    closed = F.coalesce("reserved", F.lit(False)) & filtered
    kept = F.coalesce("text", X.clean_text(F.col("summary")))
    kept = kept if blank_is_text else F.nullif(kept, F.lit(""))
    body = F.when(F.col("_step").isNull() & ~closed, kept)
    read = read.withColumn("body", body).withColumn(
        "_all", F.when(F.col("_step").isNull(), _all_texts(F.col("title"), F.col("body")))
    )
    read = read.withColumn(
        "_step",
        F.coalesce("_step", F.when(filtered & ~X.names_anyone(F.col("_all"), names.forms, names.surnames), "outside")),
    ).withColumn("sha256", F.when(F.col("_step").isNull(), X.fingerprint(F.col("title"), F.coalesce("body", "url"))))
    # Reading and matching the texts is the costly part and is used twice below: once to find repeats, once for the rows.
    read = written(
        read.select(
            "source", "level", "channel", "ord", "url", "title", "published_at", "reserved", "body", "sha256", "_step",
            F.when(F.col("_step").isNull(), X.mentions(F.col("_all"), names.forms)).alias("_subjects"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "read",
    )
    open_rows = read.filter(F.col("_step").isNull())
    first_url = newest(open_rows, ["url"], order)
    stored = newest(first_url, ["sha256"], order).select("_row", F.lit(True).alias("_stored"))
    done = read.join(stored, "_row", "left").withColumn(
        "outcome", F.coalesce("_step", F.when(F.col("_stored"), "stored").otherwise("duplicate"))
    )
    is_stored = F.col("outcome") == "stored"

    def only(c: Column) -> Column:
        return F.when(is_stored, c)

    phrase_source = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    return done.select(
        "source", "level", "channel", "ord", "url", "outcome", "title", "published_at", "reserved",
        only(U.host(F.col("url"))).alias("domain"), only(F.col("sha256")).alias("sha256"), only(F.col("body")).alias("text"),
        only(F.when(filtered & F.col("body").isNotNull(), now + F.make_dt_interval(F.lit(p.text_days)))).alias(
            "text_expires_at"
        ),
        F.lit(None).cast("timestamp").alias("text_cleared_at"),
        only(F.col("_subjects")).alias("subjects"),
        only(X.suspicious_phrase(phrase_source)).alias("suspicious"),
    )


STORED = (
    "source", "level", "channel", "url", "domain", "title", "published_at", "sha256", "text", "text_expires_at",
    "text_cleared_at", "reserved", "subjects", "suspicious",
)


def stored_documents(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("outcome") == "stored").select(*STORED)


def run_health(judged: DataFrame) -> DataFrame:
    """(source, found, new, outside) of one pass."""
    outcome = F.col("outcome")
    return judged.groupBy("source").agg(
        F.count("*").alias("found"), F.count_if(outcome == "stored").alias("new"),
        F.count_if(outcome == "outside").alias("outside"),
    )


def pass_summary(health: DataFrame) -> DataFrame:
    """One row over a pass (source, found, new, outside, error): totals, sources in error, whether all failed."""
    failed = F.col("error").isNotNull()
    return health.agg(
        F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("new"), F.lit(0)).alias("new"),
        F.coalesce(F.sum("outside"), F.lit(0)).alias("outside"), F.count_if(failed).alias("failed"),
        F.coalesce(F.bool_and(failed), F.lit(False)).alias("all_failed"),
    )


def retention(documents: DataFrame, now: Column) -> DataFrame:
    """The table with texts that expired by `now` cleared and the clearing time recorded; nothing else changes."""
    due = F.col("text").isNotNull() & (F.col("text_expires_at") <= now)
    return documents.select(
        *[
            F.when(~F.coalesce(due, F.lit(False)), F.col("text")).alias("text") if c == "text"
            else F.when(due, now).otherwise(F.col("text_cleared_at")).alias("text_cleared_at")
            if c == "text_cleared_at" else F.col(c)
            for c in documents.columns
        ]
    )


def with_quota(elements: DataFrame, source: str, order: list[str], quota: int = 30) -> DataFrame:
    """Adds `now`: the element is among the first `quota` of its source in discovery order, the rest wait for the next pass
    and stay in the table. `order` must tell the elements of a source apart.

    The first ones are found by rank, which each task cuts to the quota before anything moves; a source with very many new
    pages is not gathered.
    """
    first = newest(elements.select(source, *order), [source], [F.col(c) for c in order], quota).withColumn("_now", F.lit(True))
    same = elements[source].eqNullSafe(F.col("_source"))
    first = first.withColumnRenamed(source, "_source")
    for c in order:
        same = same & elements[c].eqNullSafe(F.col(f"_{c}"))
        first = first.withColumnRenamed(c, f"_{c}")
    return elements.join(first, same, "left").select(*elements.columns, F.coalesce("_now", F.lit(False)).alias("now"))
