"""Reports sent by readers: decoy field, minimum length, and limits per sender and per day.

Order of the rules: a filled decoy field is answered 'ok' and not stored; a text under 10 characters is refused; a sender
with 5 accepted reports in the last hour is refused; after 500 accepted reports in the last day everyone is refused.
Only accepted reports count. The text rules need no state and run before any shuffle.

Limits are kept by whole seconds (see `limits`): the daily limit, which is for everybody, is decided on at most 86,400 counts
a day however many reports arrive. It sees what the sender limit lets through; while it is exhausted, a report it refuses
still counts for its sender during that hour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyframe.streaming.limits import Limit
from tallyframe.streaming.limits import limited as limited_by

# Limits on reports.
MIN_TEXT = 10
PER_SENDER, SENDER_SPAN = 5, timedelta(hours=1)
PER_DAY, DAY_SPAN = 500, timedelta(days=1)
MAX_URL, MAX_TEXT, MAX_CONTACT = 500, 4000, 200


def screened(reports: DataFrame) -> DataFrame:
    """Adds `verdict`: 'decoy', 'too_short', or NULL when the limits decide."""
    verdict = F.when(F.coalesce("trap", F.lit("")) != "", "decoy").when(
        F.length(F.coalesce("text", F.lit(""))) < MIN_TEXT, "too_short"
    )
    return reports.withColumn("verdict", verdict)


def stored_columns() -> list[Column]:
    """What is kept of a report: whole values, and a flag where one is longer than expected."""
    return [
        "report_id", "url", "text", F.nullif("contact", F.lit("")).alias("contact"), "origin", "created_at",
        ((F.length("url") > MAX_URL) | (F.length("text") > MAX_TEXT) | (F.length("contact") > MAX_CONTACT)).alias("too_long"),
    ]


class SlidingLimit(StatefulProcessor):
    """Accepts a row when fewer than `limit` rows of its key were accepted in the span before it.

    State: the accepted times still inside the span, at most `limit`. Rows of a key are taken in time order within a
    micro-batch; the size of a micro-batch is bounded by the source.
    """

    def __init__(self, limit: int, span: timedelta) -> None:
        self.limit = limit
        self.span = int(span.total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = list(self.accepted.get()[0]) if self.accepted.exists() else []
        batch = pd.concat(list(rows)).sort_values(["at", "report_id"], kind="stable")
        verdicts = []
        for at in batch["at"].tolist():
            while held and held[0] <= at - self.span:
                held.pop(0)
            if len(held) < self.limit:
                held.append(at)
                verdicts.append(True)
            else:
                verdicts.append(False)
        self.accepted.update((held,))
        yield pd.DataFrame({"key": key[0], "report_id": batch["report_id"], "at": batch["at"], "accepted": verdicts})

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def limited(stream: DataFrame, key: Column, limit: int, span: timedelta) -> DataFrame:
    """(key, report_id, at, accepted) of a stream of reports. Needs the RocksDB state store (see `state_store`)."""
    keyed = stream.select(key.alias("key"), "report_id", F.unix_micros("created_at").alias("at"))
    return keyed.groupBy("key").transformWithStateInPandas(
        SlidingLimit(limit, span), "key string, report_id bigint, at bigint, accepted boolean", "Append", "None"
    )


def by_sender(reports: DataFrame) -> DataFrame:
    waiting = screened(reports).filter(F.col("verdict").isNull())
    return limited(waiting, F.col("origin"), PER_SENDER, SENDER_SPAN)


SENDER = Limit("sender_limit", PER_SENDER, int(SENDER_SPAN.total_seconds()))
DAY = Limit("day_limit", PER_DAY, int(DAY_SPAN.total_seconds()))


def into_reports(target: str, sender: Limit = SENDER, day: Limit = DAY) -> Callable[[DataFrame, int], None]:
    """Batch writer: stores the accepted reports under `target`/accepted and what each sender is told, a verdict per report,
    under `target`/verdicts, a folder per micro-batch. The state of the limits lies beside them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        judged = screened(batch).withColumn("second", F.floor(F.unix_micros("created_at") / 1_000_000))
        order = [F.col("created_at"), F.col("report_id")]
        waiting = judged.filter(F.col("verdict").isNull())
        passed = limited_by(waiting, F.col("origin"), sender, f"{target}/{sender.name}", batch_id, order)
        accepted = limited_by(passed, F.lit("all"), day, f"{target}/{day.name}", batch_id, order)
        accepted.select(*stored_columns()).write.mode("overwrite").parquet(f"{target}/accepted/batch_id={batch_id}")
        spark = batch.sparkSession
        let_through = passed.select("report_id", F.lit(True).alias("_passed")).join(
            spark.read.parquet(f"{target}/accepted/batch_id={batch_id}").select("report_id", F.lit(True).alias("_stored")), "report_id", "left"
        )
        told = F.when(F.col("_stored"), "accepted").when(F.col("_passed"), day.name).otherwise(sender.name)
        judged.join(let_through, "report_id", "left").select("report_id", F.coalesce("verdict", told).alias("verdict")).write.mode("overwrite").parquet(
            f"{target}/verdicts/batch_id={batch_id}"
        )
        batch.unpersist()

    return write


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state with several values lives in RocksDB, on disk, with its changes in the checkpoint. The session's own
    provider is put back afterwards."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
