"""Connected components of pairs, as a Spark job: labels spread to neighbours and jump to the label of their label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import written


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) of every node of the pairs (a, b): the label is the smallest node reachable.

    A round takes the smallest label among a node and its neighbours, then the label of that label, so paths halve. Each
    round is written, and the rounds end when no label changes.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        then = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        new = written(new.join(then, "next").select("node", F.least("next", "jump").alias("label"), F.col("label").alias("old")), "labels")
        labels = new.select("node", "label")
        if new.filter("label != old").isEmpty():
            return labels
