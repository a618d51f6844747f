"""Queries that work off landed files as streams and return the tables they filled."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.plans.registry import query
from tallyframe.storage import fresh_folder
from tallyframe.streaming import ingest as I
from tallyframe.streaming import reports as RP
from tallyframe.tables import KeyedTable


def events(d):
    # the table is a file or a folder of part files; a pattern reads either
    landed = I.landed(d.spark, f"{d.folder}/events.parque[t]", d.table("events").schema)
    return landed.withColumn("ts", F.col("ts").cast("timestamp"))


def finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(d):
    target = fresh_folder(d.spark, "stream-dedup")
    rows = I.once_within(events(d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "3 hours")
    finish(I.run(rows, I.into_table(f"{target}/table", ["user_id", "event_type"], [F.col("ts")]), f"{target}/checkpoint"))
    return d.spark.read.parquet(f"{target}/table").select("user_id", "event_type")


@query("stream_health", "SELECT event_type AS source, count(*) AS found FROM events GROUP BY 1")
def stream_health(d):
    target = fresh_folder(d.spark, "stream-health")
    write = I.with_health(f"{target}/health", "event_type", I.into_table(f"{target}/table", ["event_id"]))
    finish(I.run(events(d).select("event_id", "event_type"), write, f"{target}/checkpoint"))
    return d.spark.read.parquet(f"{target}/health").groupBy("source").agg(F.sum("found").alias("found"))


@query("stream_resume", "SELECT event_id, user_id FROM events WHERE ts >= timestamp '2024-01-10 00:00:00'")
def stream_resume(d):
    """Two runs over the same files, the second with a lost checkpoint: the table holds each row once."""
    target = fresh_folder(d.spark, "stream-resume")
    mark = F.expr("timestamp '2024-01-10 00:00:00'")
    for attempt in ("first", "second"):
        rows = I.since(events(d), "ts", mark).select("event_id", "user_id")
        finish(I.run(rows, I.into_table(f"{target}/table", ["event_id"]), f"{target}/checkpoint-{attempt}"))
    return KeyedTable(d.spark, f"{target}/table", "event_id long, user_id long", ["event_id"]).read()


@query("stream_blocks", "SELECT event_id, user_id, event_type FROM events")
def stream_blocks(d):
    """Events delivered in eight blocks. The source breaks off in the third, after its rows are stored but before the block is
    done, and once more in the fifth, before anything is stored; two restarts finish the work. Every row is there once."""
    target = fresh_folder(d.spark, "stream-blocks")
    I.land_blocks(d.table("events").select("event_id", "user_id", "event_type"), f"{target}/landed", "event_id", 8)
    table = I.into_table(f"{target}/table", ["event_id"])
    breaks = {2, 4}

    def write(batch, batch_id):
        if batch_id == 4 and batch_id in breaks:
            breaks.discard(batch_id)
            raise ConnectionError("blocked by the source")
        table(batch, batch_id)
        if batch_id in breaks:
            breaks.discard(batch_id)
            raise ConnectionError("blocked by the source")

    rows = I.landed(d.spark, f"{target}/landed", "event_id long, user_id long, event_type string", "*.parquet", files_per_trigger=1)
    for _ in range(3):
        if I.run_blocks(rows, write, f"{target}/checkpoint") is None:
            break
    return KeyedTable(d.spark, f"{target}/table", "event_id long, user_id long, event_type string", ["event_id"]).read()


# Each sender's reports in order, then all that passed in order, one row a step: how many were accepted in the span before.
REPORTS_SQL = """
reports AS (SELECT event_id AS report_id, ts AS created_at, epoch_us(ts) // 1000000 AS second, 'u' || user_id AS origin, 'reported: ' || props AS text,
  CASE WHEN event_id % 11 = 0 THEN 'decoy' WHEN event_id % 13 = 0 THEN 'too_short' END AS screened FROM events),
waiting AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY second, created_at, report_id) AS i FROM reports WHERE screened IS NULL),
senders AS MATERIALIZED (WITH RECURSIVE s AS (
  SELECT origin, i, report_id, second, [second] AS held, true AS ok FROM waiting WHERE i = 1
  UNION ALL
  SELECT origin, i, report_id, second, CASE WHEN len(h) < 5 THEN list_append(h, second) ELSE h END, len(h) < 5
  FROM (SELECT w.*, list_filter(s.held, lambda x: x > w.second - 3600) AS h FROM s JOIN waiting w ON w.origin = s.origin AND w.i = s.i + 1))
  SELECT report_id, second, ok FROM s),
passed AS MATERIALIZED (SELECT report_id, second, row_number() OVER (ORDER BY second, created_at, report_id) AS k FROM senders JOIN reports USING (report_id, second) WHERE ok),
days AS MATERIALIZED (WITH RECURSIVE t AS (
  SELECT k, report_id, [second] AS held, true AS ok FROM passed WHERE k = 1
  UNION ALL
  SELECT k, report_id, CASE WHEN len(h) < 500 THEN list_append(h, second) ELSE h END, len(h) < 500
  FROM (SELECT p.*, list_filter(t.held, lambda x: x > p.second - 86400) AS h FROM t JOIN passed p ON p.k = t.k + 1))
  SELECT report_id, ok FROM t)
"""


def filled_reports(d):
    """Events as reports of their users, stored: one in eleven fills the decoy field, one in thirteen is too short."""
    target = fresh_folder(d.spark, "stream-reports")
    key = F.col("event_id")
    reports = events(d).select(
        key.alias("report_id"), F.lit("/page").alias("url"),
        F.when(key % 13 == 0, "short").otherwise(F.concat(F.lit("reported: "), "props")).alias("text"),
        F.lit("").alias("contact"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("origin"),
        F.when(key % 11 == 0, "x").alias("trap"), F.col("ts").alias("created_at"),
    )
    finish(I.run(reports, RP.into_reports(target), f"{target}/checkpoint"))
    return target


@query("stream_rate_limit", f"""
    WITH {REPORTS_SQL}
    SELECT report_id, '/page' AS url, text, NULL AS contact, origin, created_at, false AS too_long FROM days JOIN reports USING (report_id) WHERE ok""")
def stream_rate_limit(d):
    return d.spark.read.parquet(f"{filled_reports(d)}/accepted").drop("batch_id")


@query("report_verdicts", f"""
    WITH {REPORTS_SQL}
    SELECT report_id, CASE WHEN screened IS NOT NULL THEN screened WHEN NOT s.ok THEN 'sender_limit' WHEN NOT t.ok THEN 'day_limit' ELSE 'accepted' END AS verdict
    FROM reports LEFT JOIN senders s USING (report_id) LEFT JOIN days t USING (report_id)""")
def report_verdicts(d):
    return d.spark.read.parquet(f"{filled_reports(d)}/verdicts").drop("batch_id")
