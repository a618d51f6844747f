"""Mixing sources to target weights: equal-token blocks apportioned by the method of Sainte-Laguë, then picked by a seed.

Targets are the sources' weighted shares of all tokens, at most `epochs` times what a source has; the excess is reshared
by weight until no source is above its limit. Seats are blocks of equally many tokens; the method is house-monotone, so the
quotas of the first k shards are the apportionment of their seats, and each shard's quota is a difference of two of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import free_name, offsets, raw_words, total, written
from tallyframe.llm.registry import query


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (1, 2, 3)  # of the sources in code-point order, NULL last, repeating
    epochs: int = 3  # no document is taken more often
    block: int = 32  # tokens a block
    shards: int = 8
    seed: str = "mix"


ROWS_A_BUCKET = 10_000


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows. One row per source: windows over it are small.

    Sources whose limit is reached at the common level of the others get their limit. With no tokens at all targets are 0.
    """
    sources = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(mix.weights)), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(mix.weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight.cast("bigint")).withColumn("limit", F.col("source_size") * mix.epochs)
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    none = F.lit(0).cast("bigint")
    rows = (
        rows.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("rest", F.col("all_size") - F.coalesce(F.sum("limit").over(before), none))
        .withColumn("rest_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), none))
        .withColumn("full", F.col("limit") * F.col("rest_weight") <= F.col("weight") * F.col("rest"))
        .withColumn("used", F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), none))
        .withColumn("used_weight", F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), none))
    )
    share = (F.col("weight") * (F.col("all_size") - F.col("used"))).cast("double") / (F.col("all_weight") - F.col("used_weight"))
    return rows.select("source", "source_size", "weight", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def block_quotas(targets: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, shard, quota): how many blocks of each source go to each shard.

    With S sources and N seats a quota lies between ceil(t(N - S/2) - 1/2) and floor(t(N + S/2) + 1/2), t being the
    source's part of all targets; only quotients t / (2k + 1) in that range compete for the seats left, about 2 S rows.
    """
    found = total(targets, F.coalesce(F.sum("target"), F.lit(0.0)).alias("t"), F.count(F.lit(1)).alias("s"))
    if not found["t"]:
        return targets.select("source", F.explode(F.sequence(F.lit(0), F.lit(mix.shards - 1))).alias("shard"), F.lit(0).cast("bigint").alias("quota"))
    blocks, half = max(1, round(found["t"] / mix.block)), found["s"] / 2
    rows = targets.select(
        "source", F.col("target"), F.explode(F.sequence(F.lit(1), F.lit(mix.shards))).alias("upto")
    ).withColumn("seats", F.expr(f"{blocks}L * upto div {mix.shards}"))
    part = F.col("target") / F.lit(found["t"])
    rows = rows.withColumn("sure", F.greatest(F.lit(0.0), F.ceil(part * (F.col("seats") - half) - 0.5)).cast("bigint")).withColumn(
        "most", F.floor(part * (F.col("seats") + half) + 0.5).cast("bigint") + 1
    )
    open_seats = rows.groupBy("upto").agg((F.first("seats") - F.sum("sure")).alias("open"))
    rivals = rows.select("source", "upto", "target", F.explode(F.expr("sequence(sure, greatest(most, sure + 1) - 1)")).alias("k"))
    order = Window.partitionBy("upto").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last(), "k")
    won = (
        rivals.withColumn("place", F.row_number().over(order)).join(open_seats, "upto").filter(F.col("place") <= F.col("open"))
        .groupBy("source", "upto").agg(F.count(F.lit(1)).alias("won"))
    )
    w = won.select(F.struct("source", "upto", "won").alias("w"))
    upto = rows.join(w, F.col("source").eqNullSafe(F.col("w.source")) & (F.col("upto") == F.col("w.upto")), "left").select(
        "source", "upto", (F.col("sure") + F.coalesce(F.col("w.won"), F.lit(0))).alias("seats")
    )
    earlier = F.lag("seats", 1, 0).over(Window.partitionBy("source").orderBy("upto"))
    return upto.select("source", (F.col("upto") - 1).alias("shard"), (F.col("seats") - earlier).alias("quota"))


def mixed(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(…, source_size, target, taken) for rows with doc_id, source and size: how many of its tokens the mix takes.

    A source's documents stand end to end in the order of the seeded md5 of their ids and are cut into equal blocks; its
    quota takes whole passes and then the first blocks of one more. A document counts once per pass and its part in the
    last one. Repeated rows stand one after the other. Quotas are summed over the shards: none is dealt blocks of its own. The
    rows must come from a written table.
    """
    plan = source_targets(rows.select("source", "size"), mix)
    plan = written(plan, "targets")
    quotas = block_quotas(plan, mix).groupBy("source").agg(F.sum("quota").alias("quota"))
    q = quotas.select(F.struct("source", "quota").alias("q"))
    words = F.least(F.col("q.quota") * mix.block, F.col("source_size") * mix.epochs)
    passes = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0))
    taking = plan.join(q, F.col("source").eqNullSafe(F.col("q.source"))).withColumn("words", words).withColumn("passes", passes)
    taking = taking.select(F.struct("source", "source_size", "target", "passes", (F.col("words") - F.col("passes") * F.col("source_size")).alias("rest")).alias("plan"))

    n = total(rows, F.count(F.lit(1)).alias("n"))["n"]
    buckets = max(1, math.ceil(n / ROWS_A_BUCKET))
    placed = rows.withColumn("place", F.md5(F.concat_ws(":", F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))))
    placed = placed.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(1 << 32)).cast("bigint"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    shift = offsets(sums, "source", "bucket", "size", "before").select(F.struct("source", "bucket", "before").alias("shift"))
    own = Window.partitionBy("source", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    laid = laid.join(shift, F.col("source").eqNullSafe(F.col("shift.source")) & (F.col("bucket") == F.col("shift.bucket")))
    laid = laid.join(taking, F.col("source").eqNullSafe(F.col("plan.source")))
    start = F.col("inside") + F.col("shift.before")
    last = F.least(F.col("size"), F.greatest(F.lit(0), F.col("plan.rest") - start))
    return laid.select(
        *rows.columns, F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"),
        (F.col("plan.passes") * F.col("size") + last).cast("bigint").alias("taken"),
    )


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """(…, doc_id, source, size): the words of each text, 0 for NULL; `more` columns are kept."""
    return docs.select(
        *more,
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.size(raw_words(F.col("text"))).cast("bigint").alias("size"),
    )


def take(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, each as often as it is taken begun: a document taken 2.4 times gives three
    rows. Each row is taken for itself, whatever other rows have its id. The mix may leave documents of a source out
    altogether; that is what it is for."""
    at, times = free_name(docs, "at"), free_name(docs, "times")
    numbered = written(docs.withColumn(at, F.monotonically_increasing_id()), "numbered")
    taken = mixed(written(sized(numbered, at), "sizes")).filter("taken > 0")
    counts = taken.select(at, F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times))
    return numbered.join(counts, at).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)


MIX = Mix()
TARGET_SQL = """
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sz GROUP BY source),
lvl AS (SELECT *, 3 * source_size AS lim, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS rest,
          sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest_weight
        FROM src WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ful AS (SELECT *, lim * rest_weight <= weight * rest AS is_full FROM lvl),
tgt AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(lim AS DOUBLE) ELSE
          CAST(weight * (sum(source_size) OVER () - coalesce(sum(lim) FILTER (is_full) OVER (), 0)) AS DOUBLE)
          / (sum(weight) OVER () - coalesce(sum(weight) FILTER (is_full) OVER (), 0)) END AS target FROM ful),
blk AS (SELECT CAST(round_even(sum(target) / 32, 0) AS BIGINT) AS n, sum(target) AS t FROM tgt),
quo AS (SELECT source, count(*) AS quota FROM (
          SELECT source FROM tgt, blk, range(CAST(ceil(n * target / t) AS BIGINT) + (SELECT count(*) FROM tgt)) AS k(k)
          QUALIFY row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) <= any_value(n) OVER ()) GROUP BY source),
pln AS (SELECT tgt.*, least(coalesce(quota, 0) * 32, 3 * source_size) AS words FROM tgt LEFT JOIN quo ON tgt.source IS NOT DISTINCT FROM quo.source),
mix AS (SELECT sz.*, pln.source_size, pln.target, CAST(CASE WHEN pln.source_size = 0 THEN 0 ELSE words // pln.source_size * size
          + least(size, greatest(0, words % pln.source_size - coalesce(sum(size) OVER (PARTITION BY sz.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'none')), size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS BIGINT) AS taken
        FROM sz JOIN pln ON sz.source IS NOT DISTINCT FROM pln.source)
"""
SIZES_SQL = r"sz AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}),"


@query("op4_mixing", "WITH " + SIZES_SQL.format(docs="documents") + TARGET_SQL + "SELECT doc_id, size, source_size, target, taken FROM mix")
def op4_mixing(spark, sf_dir):
    rows = written(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    return mixed(rows).select("doc_id", "size", "source_size", "target", "taken")
