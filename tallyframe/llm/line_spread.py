"""Removal of lines that stand on many sites, by the number of distinct sites of each line.

Each line's sites go into a HyperLogLog sketch; sketches of one line merge by aggregation, so a line on every page costs one
row per task. An estimate far from the limit decides; lines near it are counted exactly, so the result is that of exact
counts. Sketches of few sites are exact in themselves; `band` is many times the error of the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import written
from tallyframe.llm.registry import query

BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Spread:
    sites: int = 10  # a line on so many sites or more is boilerplate
    log_buckets: int = 12  # of the sketches: a relative error of 1.6 %
    band: float = 0.2  # around the limit, within which sites are counted exactly


def _line_key(line: Column) -> Column:
    """Two hashes of the line without the blanks around it; NULL for a blank line."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b")))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(id, rid, site, at, line) of every line that is not blank, in the place of its line in the text."""
    keys = F.transform(F.split("text", "\n"), _line_key)
    lines = docs.select("id", "rid", "site", F.posexplode(keys).alias("at", "line")).filter("line IS NOT NULL")
    return lines.select("id", "rid", "site", "at", "line.a", "line.b")


def boilerplate(lines: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """(a, b) of the lines on `sites` sites or more. A NULL site is one site."""
    site = F.coalesce(F.concat(F.lit("s"), "site"), F.lit("none"))
    sketched = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg(site, F.lit(spread.log_buckets))).alias("n"))
    # lines far below the limit, nearly all, end here
    near = written(sketched.filter(F.col("n") >= spread.sites * (1 - spread.band)), "spread-lines")
    sure = near.filter(F.col("n") > spread.sites * (1 + spread.band)).select("a", "b")
    close = near.filter(F.col("n") <= spread.sites * (1 + spread.band)).select("a", "b")
    exact = lines.join(close, ["a", "b"]).select("a", "b", site.alias("site")).distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return sure.unionByName(exact.filter(F.col("n") >= spread.sites).select("a", "b"))


def without_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", row: str = "doc_id", spread: Spread = Spread()) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): the lines of each text that are not blank, those removed, and the text without
    them. Blank lines stay; NULL is the empty text; rows that repeat an id and a text are judged alike."""
    docs = docs.select(
        F.col(row).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(site).cast("string").alias("site")
    ).withColumn("id", F.coalesce("doc_id", F.lit(-1).cast("bigint"))).withColumn("rid", F.xxhash64("text"))
    lines = written(numbered_lines(docs), "lines")
    wide = written(boilerplate(lines, spread), "boilerplate")
    marks = lines.join(wide, ["a", "b"], "left_semi").groupBy("id", "rid").agg(F.collect_set("at").alias("marks"))
    marked = docs.join(marks, ["id", "rid"], "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<int>")))
    all_ = F.split("text", "\n")
    kept = F.when(F.size("marks") == 0, F.col("text")).otherwise(
        F.array_join(F.filter(all_, lambda _, i: ~F.array_contains("marks", i)), "\n")
    )
    full = F.size(F.filter(all_, lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return marked.select("doc_id", full.cast("bigint").alias("n_lines"), F.size("marks").cast("bigint").alias("n_removed"), kept.alias("kept"))


@query("op7_line_spread", rf"""
WITH ln AS (SELECT r, doc_id, site, i, l, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM (
              SELECT r, doc_id, site, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (
                SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'none') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
wide AS (SELECT k FROM ln WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= {Spread().sites})
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (k IN (SELECT k FROM wide)) AS n_removed,
       coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM wide)), '') AS kept
FROM ln GROUP BY r""")
def op7_line_spread(spark, sf_dir):
    return without_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
