"""Sharding by jump consistent hashing: the key and the number of shards decide, without a table of the ring.

The key's 64-bit linear congruential sequence gives ever longer jumps; the last one below the number of shards is the
shard. One more shard therefore only takes rows into itself. 64-bit arithmetic is done on 32-bit halves, as SQL integers
must not overflow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import free_name, offsets, total, written
from tallyframe.llm.registry import query

SHARDS = 40
NO_KEY = -1  # the key of a row whose key is NULL
ROWS_A_BUCKET = 200_000

# Fixed value of the published algorithm: the multiplier of its generator.
MULTIPLIER = 2862933555777941757
_LOW32, _LOW16 = (1 << 32) - 1, (1 << 16) - 1


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) of MULTIPLIER * key + 1 modulo 2^64; no intermediate value passes 2^62."""
    a_hi, a_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW32
    u, v = a_lo >> 16, a_lo & _LOW16
    mid = lo * u
    low = lo * v + 1 + F.shiftleft(mid.bitwiseAND(_LOW16), 16)
    high = (
        F.shiftright(low, 32) + F.shiftright(mid, 16) + (lo * a_hi).bitwiseAND(_LOW32) + hi * v
        + F.shiftleft((hi * u).bitwiseAND(_LOW16), 16)
    )
    return high.bitwiseAND(_LOW32), low.bitwiseAND(_LOW32)


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard among `shards`, and among one more. A NULL key counts as NO_KEY."""
    key = F.coalesce(key.cast("bigint"), F.lit(NO_KEY).cast("bigint"))
    state = F.struct(
        F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("grown"), F.lit(0).cast("bigint").alias("at"),
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_LOW32).alias("lo"),
    )

    def step(s: Column, _: Column) -> Column:
        def moved(n: Column) -> Column:
            return F.struct(
                s["at"].alias("shard"), s["at"].alias("grown"),
                F.floor((s["at"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(n["hi"], 1) + 1).cast("double")))
                .cast("bigint").alias("at"),
                n["hi"].alias("hi"), n["lo"].alias("lo"),
            )

        hi, lo = _next(s["hi"], s["lo"])
        stepped = F.element_at(F.transform(F.array(F.struct(hi.alias("hi"), lo.alias("lo"))), moved), 1)
        # a jump lands: it is the shard if below the number, and the grown one if at most the number
        landed = F.when(s["at"] < shards, stepped).otherwise(
            F.struct(s["shard"].alias("shard"), s["at"].alias("grown"), F.lit(shards + 1).cast("bigint").alias("at"), s["hi"].alias("hi"), s["lo"].alias("lo"))
        )
        return F.when(s["at"] > shards, s).otherwise(landed)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(shards + 1)), state, step)
    return F.element_at(
        F.transform(F.array(end), lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown"))), 1
    )


def slots(rows: DataFrame, group: str, key: str, ties: list[str], at: str, target: int = ROWS_A_BUCKET) -> DataFrame:
    """Adds `slot`: 0, 1, 2, ... within each group, by key (NULL first), then `ties`.

    Rows are numbered inside buckets of a range of keys and shifted by the rows of the buckets before, so no task sorts a
    whole group. A bucket of one key that is still too large is dealt out by `at`, a number of each row. The rows must
    come from a written table: both passes have to read the same ones.
    """
    lo, part, before, stats = (free_name(rows, x) for x in ("range", "part", "before", "stats"))
    found = total(rows, F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    buckets = max(1, math.ceil(found["n"] / target))
    width = max(1, math.ceil(((found["hi"] or 0) - (found["lo"] or 0) + 1) / buckets))
    first = F.lit(found["lo"] or 0).cast("decimal(20,0)")
    ranged = rows.withColumn(lo, F.coalesce(F.floor((F.col(key).cast("decimal(20,0)") - first) / width).cast("bigint"), F.lit(-1).cast("bigint")))
    sizes = ranged.groupBy(group, lo).agg(F.count(F.lit(1)).alias("n"), F.min(key).eqNullSafe(F.max(key)).alias("one"))
    parts = sizes.select(F.struct(
        F.col(group).alias("g"), F.col(lo).alias("b"),
        F.when(F.col("one"), F.ceil(F.col("n") / target)).otherwise(F.lit(1)).cast("bigint").alias("k"),
    ).alias(stats))
    dealt = (
        ranged.join(parts, ranged[group].eqNullSafe(F.col(stats)["g"]) & (ranged[lo] == F.col(stats)["b"]))
        .withColumn(part, F.struct(F.col(lo), F.pmod(F.col(at), F.col(stats)["k"]).alias("salt"))).drop(stats)
    )
    counts = dealt.groupBy(group, part).agg(F.count(F.lit(1)).alias("n"))
    shift = offsets(counts, group, part, "n", "before").select(F.struct(F.col(group).alias("g"), F.col(part).alias("p"), "before").alias(before))
    own = Window.partitionBy(group, part).orderBy(F.col(key).asc_nulls_first(), *ties)
    numbered = dealt.withColumn("slot", F.row_number().over(own) - 1)
    return (
        numbered.join(shift, numbered[group].eqNullSafe(F.col(before)["g"]) & (numbered[part] == F.col(before)["p"]))
        .withColumn("slot", (F.col("slot") + F.col(before)["before"]).cast("bigint")).drop(before, part, lo, at)
    )


def with_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: its size (bytes and 16 for the record's head; a NULL text has none), checksum of the text
    (0 for none), shard, place in the shard and the shard if there were one more. Repeated rows get a place each."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), jump(F.col("doc_id"), shards).alias("j"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = placed.select("doc_id", "size", "text_crc32", F.col("j.shard").alias("shard"), F.col("j.grown").alias("grown_shard"), "at")
    return slots(written(rows, "placed"), "shard", "doc_id", ["text_crc32", "size"], "at")


def assign(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where each document goes."""
    return with_shards(docs).select("doc_id", "size", "shard", "slot", "grown_shard")


# The jumps of one key as a recursive list: (shard, grown shard, next landing, state)
SHARD_SQL = f"""
keys AS (SELECT DISTINCT coalesce(doc_id, {NO_KEY}) AS k FROM {{docs}}),
jumps AS (
  WITH RECURSIVE j(k, s, b, nx) AS (
    SELECT k, CAST(CASE WHEN k < 0 THEN CAST(k AS HUGEINT) + 18446744073709551616 ELSE k END AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM keys
    UNION ALL
    SELECT k, ns, nx, CAST(floor(CAST(nx + 1 AS DOUBLE) * (2147483648.0::DOUBLE / CAST(ns // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
    FROM (SELECT k, nx, (((s // 4294967296) * {MULTIPLIER} % 4294967296) * 4294967296 + (s % 4294967296) * {MULTIPLIER} + 1) % 18446744073709551616 AS ns
          FROM j WHERE nx <= {SHARDS}))
  SELECT k, CAST(max(b) FILTER (b < {SHARDS}) AS INTEGER) AS shard, CAST(max(CASE WHEN nx <= {SHARDS} THEN nx ELSE b END) AS INTEGER) AS grown_shard
  FROM j GROUP BY k)
"""


# Checksum of a text's bytes: the usual table of remainders (polynomial 0xEDB88320), built by rule, applied byte by byte
CRC_SQL = """
one AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(0 AS BIGINT) FOR _ IN range(8)]),
          lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS remainders),
crc AS (SELECT r, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
          lambda c, b: xor(c // 256, remainders[xor(c, b) % 256 + 1]))) AS text_crc32
        FROM (SELECT r, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM rows_), one)
"""


@query(
    "op3_sharding",
    "WITH " + SHARD_SQL.format(docs="documents") + f""",
rows_ AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents), {CRC_SQL}
SELECT doc_id, CAST(strlen(t) + 16 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, strlen(t)) - 1 AS slot, grown_shard
FROM rows_ JOIN crc USING (r) JOIN jumps ON jumps.k = coalesce(doc_id, {NO_KEY})""",
)
def op3_sharding(spark, sf_dir):
    rows = with_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
