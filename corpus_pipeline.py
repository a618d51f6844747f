"""From raw documents to shards: each stage works on all documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontamination, host_rules, jaccard, mixing, sharding
from tallyframe.storage import written

STAGES = [
    ("quality_rules", host_rules.keep_good),
    ("near_duplicates", jaccard.one_of_each),
    ("decontamination", decontamination.remove_contaminated),
    ("mixing", mixing.take),
    ("sharding", sharding.assign),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The rows of run(), for documents whose ids differ.
ORACLE_SQL = f"""
WITH {host_rules.KEPT_SQL.format(docs="documents")},
good AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM verdicts WHERE kept)),
{jaccard.NEAR_SQL.format(docs="good")},
single AS (SELECT * FROM good WHERE doc_id IN (SELECT doc_id FROM near WHERE doc_id = component_id)),
{decontamination.HITS_SQL.format(docs="single")},
clean AS (SELECT * FROM single WHERE doc_id NOT IN (SELECT doc_id FROM dw WHERE r IN (SELECT r FROM hitw))),
{mixing.SIZES_SQL.format(docs="clean")}
{mixing.TARGET_SQL},
taken AS (SELECT doc_id, unnest(range(CAST(ceil(taken / size) AS BIGINT))) FROM mix WHERE taken > 0),
{sharding.SHARD_SQL.format(docs="taken")}
SELECT doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM taken JOIN clean USING (doc_id) JOIN jumps ON jumps.k = doc_id
"""
