"""Limits over sliding spans, kept by counts: so many accepted rows of a key in the seconds before each row.

A micro-batch is first counted per key and second, where the rows are, so a key with very many rows is a few thousand counts
when it moves. The counts of a key then come in the order of time through one sorted piece, next to what was accepted before,
and every second is granted a number of rows. The rows themselves are ranked only inside a second, and only as many as the
limit can let through. What was granted is the state: a small table per micro-batch, rewritten whole when a batch is replayed,
from which everything older than the span has gone.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limit:
    """`most` accepted rows of a key in `span` seconds: the second of a row and those before it."""

    name: str
    most: int
    span: int


GRANTED = "key string, second long, offered long, granted long, accepted long"


def _grant(limit: Limit):
    """Grants of seconds that come in order of key and second; `accepted` of a row is what was accepted in it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, held = None, deque(), 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "second", "offered", "accepted")]
            granted = []
            for k, second, offered, accepted in zip(*columns, strict=True):
                if not granted and key is None or k != key:
                    key, held = k, 0
                    inside.clear()
                while inside and inside[0][0] <= second - limit.span:
                    held -= inside.popleft()[1]
                take = max(0, min(offered, limit.most - held - accepted))
                if take + accepted:
                    inside.append((second, take + accepted))
                    held += take + accepted
                granted.append(take)
            total = [g + a for g, a in zip(granted, columns[3], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("second"), batch.column("offered"), pa.array(granted, pa.int64()), pa.array(total, pa.int64())],
                [c.split(" ")[0] for c in GRANTED.split(", ")],
            )

    return run


def grants(rows: DataFrame, held: DataFrame, limit: Limit) -> DataFrame:
    """(key, second, offered, granted, accepted) of rows (key, second, ...) and of what was accepted before: (key, second,
    accepted). A key that is NULL is a key."""
    offered = rows.groupBy("key", "second").agg(F.count(F.lit(1)).alias("offered")).withColumn("accepted", F.lit(0).cast("long"))
    before = held.select("key", "second", F.lit(0).cast("long").alias("offered"), "accepted")
    both = offered.unionByName(before).groupBy("key", "second").agg(F.sum("offered").alias("offered"), F.sum("accepted").alias("accepted"))
    return both.repartition("key").sortWithinPartitions("key", "second").mapInArrow(_grant(limit), GRANTED)


def taken(rows: DataFrame, granted: DataFrame, limit: Limit, order: list[Column]) -> DataFrame:
    """The first rows of each second, as many as were granted."""
    some = granted.filter("granted > 0").select(F.col("key").alias("_k"), F.col("second").alias("_s"), "granted")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("key", "second").orderBy(*order))).filter(F.col("_rank") <= limit.most)
    joined = ranked.join(some, F.col("key").eqNullSafe(F.col("_k")) & (F.col("second") == F.col("_s")))
    return joined.filter(F.col("_rank") <= F.col("granted")).select(*rows.columns)


def state_before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """What the micro-batch before left; nothing for the first."""
    try:
        return spark.read.schema(GRANTED).parquet(f"{folder}/batch_id={batch_id - 1}")
    except AnalysisException:
        return spark.createDataFrame([], GRANTED)


def limited(rows: DataFrame, key: Column, limit: Limit, folder: str, batch_id: int, order: list[Column]) -> DataFrame:
    """The rows of a micro-batch, with `second` among their columns, that the limit lets through. The state lies in
    `folder`, a table per micro-batch: a batch that runs again reads the same state and writes the same one."""
    spark = rows.sparkSession
    keyed = rows.withColumn("key", key.cast("string"))
    newest = keyed.agg(F.max("second").alias("s")).first()["s"]
    held = state_before(spark, folder, batch_id)
    path = f"{folder}/batch_id={batch_id}"
    if newest is None:
        held.write.mode("overwrite").parquet(path)
        return rows
    made = grants(keyed, held, limit)
    made.filter((F.col("granted") > 0) | (F.col("accepted") > 0) & (F.col("second") > newest - limit.span)).write.mode("overwrite").parquet(path)
    return taken(keyed, spark.read.schema(GRANTED).parquet(path), limit, order).drop("key")
