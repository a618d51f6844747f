"""People and their identities: who is one person, who has two identities at once, which votes lie outside a membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.temporal import fold_periods, valid_entries
from tallyframe.storage import written


def linked_identities(identities: DataFrame, identity: str, shared: list[str]) -> DataFrame:
    """(identity, person): identities that share a value of one of the columns `shared`, directly or through others, are one
    person, named by its smallest identity. A NULL is shared with nobody.

    Identities of one value are tied to the smallest of them, so a value of very many makes as many ties, not their pairs. Every
    round a label passes along the ties and then to the label of the label, until none changes; each round is written.
    """
    ties = None
    for column in shared:
        named = identities.filter(F.col(column).isNotNull() & F.col(identity).isNotNull())
        hub = named.groupBy(column).agg(F.min(identity).alias("b"))
        tied = named.join(hub, column).select(F.col(identity).alias("a"), "b")
        ties = tied if ties is None else ties.unionByName(tied)
    ties = written(ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ties")
    labels = written(identities.filter(F.col(identity).isNotNull()).select(F.col(identity).alias("a")).distinct().withColumn("label", F.col("a")), "labels")
    while True:
        near = ties.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, "a", "left").select("a", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        then = labels.select(F.col("a").alias("next"), F.col("label").alias("jump"))
        step = written(step.join(then, "next").select("a", "old", F.least("next", "jump").alias("label")), "labels")
        labels = step.select("a", "label")
        if step.filter("label <> old").isEmpty():
            return labels.select(F.col("a").alias(identity), F.col("label").alias("person"))


def simultaneous(periods: DataFrame, key: str, identity: str, open_end: str, stretch: str = "year") -> DataFrame:
    """(key, valid_from, valid_to, identities): the stretches of days in which a key has two identities or more, and how many.

    Each identity's periods are merged first. Then every key is a line of days on which the number changes, summed up along
    the line; a line is cut by time, with what came before carried over, so a key with very many periods is not one task.
    Periods without a start are left out; without an end they last until `open_end`.
    """
    given = periods.filter(F.col("valid_from").isNotNull() & F.col(key).isNotNull() & F.col(identity).isNotNull()).select(
        key, identity, "valid_from", F.coalesce("valid_to", F.lit(open_end).cast("date")).alias("valid_to")
    ).filter("valid_from <= valid_to")
    own = Window.partitionBy(key, identity).orderBy("valid_from", "valid_to")
    before = F.max("valid_to").over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("valid_from") > F.date_add(before, 1), F.lit(True)).cast("int")
    island = F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = given.withColumn("_new", new).withColumn("_island", island).groupBy(key, identity, "_island").agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))
    changes = merged.select(key, F.explode(F.array(
        F.struct(F.col("valid_from").alias("day"), F.lit(1).alias("n")), F.struct(F.date_add("valid_to", 1).alias("day"), F.lit(-1).alias("n"))
    )).alias("c")).groupBy(key, F.col("c.day").alias("day")).agg(F.sum("c.n").alias("n")).filter("n <> 0")
    line = changes.withColumn("_stretch", F.trunc("day", stretch))
    sums = line.groupBy(key, "_stretch").agg(F.sum("n").alias("_sum"), F.min("day").alias("_first"))
    along = Window.partitionBy(key).orderBy("_stretch")
    carried = sums.select(
        F.col(key).alias("_key"), F.col("_stretch").alias("_s"), F.coalesce(F.sum("_sum").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carried"),
        F.lead("_first").over(along).alias("_next"),
    )
    inside = Window.partitionBy(key, "_stretch").orderBy("day")
    running = line.withColumn("_run", F.sum("n").over(inside)).withColumn("_then", F.lead("day").over(inside))
    joined = running.join(carried, (F.col(key) == F.col("_key")) & (F.col("_stretch") == F.col("_s")))
    active = F.col("_run") + F.col("_carried")
    return joined.filter(active >= 2).select(
        key, F.col("day").alias("valid_from"), F.date_sub(F.coalesce("_then", "_next"), 1).alias("valid_to"), active.cast("int").alias("identities")
    )


def votes_outside_membership(votes: DataFrame, memberships: DataFrame, kind: str = "group") -> DataFrame:
    """The votes cast on a day on which their person had no membership of the kind."""
    folded = fold_periods(memberships.filter(F.col("kind") == kind).withColumn("_value", F.lit(1)), "person_id", "_value", "_periods")
    held = F.size(valid_entries(F.col("_periods"), F.col("on_date"))) > 0
    return votes.join(folded, "person_id", "left").filter(~F.coalesce(held, F.lit(False))).select(*votes.columns)
