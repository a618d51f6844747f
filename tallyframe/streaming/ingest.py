"""Append-only ingestion: each landed row is stored once under its natural key, whatever is replayed or delivered twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.tables import KeyedTable


def landed(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """Files that arrive in a folder. The number per micro-batch is bounded, so a backlog is worked off in blocks and a
    stopped run keeps the blocks it finished."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def land_blocks(rows: DataFrame, folder: str, order: str, blocks: int) -> None:
    """Lands rows as block files, each a range of `order`: what a source delivers block by block."""
    rows.repartitionByRange(blocks, order).write.parquet(folder)


def run_blocks(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> str | None:
    """Works off the blocks that have landed, one micro-batch each, until all are done or one fails.

    Returns why it stopped, or None. Blocks that were done stay done; the next call with the same checkpoint begins with the
    one that failed, whose rows may have been written already: the writer must take a row once (see `into_table`).
    """
    query = run(stream, write, checkpoint)
    try:
        query.awaitTermination()
    except StreamingQueryException as stopped:
        return str(stopped)
    return None


def once_within(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Drops repeats of a key that arrive within the delay. State older than the delay is forgotten; the table's own
    anti join catches later repeats."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def since(stream: DataFrame, event_time: str, high_water: Column) -> DataFrame:
    """Rows on or after the latest stored date (inclusive: the last day may be incomplete)."""
    return stream.filter(F.col(event_time) >= high_water)


def into_table(path: str, keys: list[str], order: list[Column] | None = None) -> Callable[[DataFrame, int], None]:
    """Batch writer: appends the rows whose key the table (see `tables.KeyedTable`) does not hold, looking for a batch's keys
    only where they may be."""

    def write(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, path, batch.schema, keys).append(batch, order)

    return write


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query. `once` works off what has landed and stops; otherwise it keeps running every minute."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def with_health(path: str, source: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Batch writer that also appends (batch_id, source, found) per source, one folder per batch so that a replayed batch
    replaces its own counts instead of adding to them. The batch is kept while both read it, so it is computed once."""

    def both(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        write(batch, batch_id)
        batch.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("found")).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}"
        )
        batch.unpersist()

    return both


def windowed_counts(stream: DataFrame, event_time: str, source: str, width: str, delay: str) -> DataFrame:
    """(window_start, source, n) in tumbling windows of event time; a window closes `delay` after its end."""
    counts = stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), source).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), source, "n")
