"""Writers. Tables are append-only: a row already stored under its natural key is never written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def absent_rows(new: DataFrame, stored: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows whose key is not stored, one per key (the first under `order`). NULL is a key value like any other."""
    from tallyframe.operators.temporal import newest

    once = newest(new, keys, order or [F.col(k) for k in keys])
    held = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return once.join(held, condition, "left_anti")


def insert_if_absent(
    new: DataFrame, path: str, keys: list[str], order: list[Column] | None = None, partition: list[str] | None = None
) -> int:
    """Appends the absent rows and returns how many there were. Running it twice writes nothing the second time."""
    spark = new.sparkSession
    rows = absent_rows(new, stored_or_empty(spark, path, new.schema), keys, order)
    from pyspark.sql import Observation

    counted = Observation()
    writer = rows.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return counted.get["n"]


def write_ballot_days(ballots: DataFrame, path: str) -> None:
    """Writes whole ballot days, replacing only the days present: a rerun of a day gives the same files, not more rows."""
    ballots.withColumn("day", F.col("ballot_date")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("day").parquet(path)


def new_group_keys(facts: DataFrame, groups: DataFrame, chamber: str, term: int) -> DataFrame:
    """Groups met in the facts and missing from the dimension, with a key derived from their natural key."""
    met = facts.select("group_ext_id").filter(F.col("group_ext_id").isNotNull()).distinct()
    missing = met.join(groups.select("group_ext_id"), "group_ext_id", "left_anti")
    natural = F.concat_ws("|", F.lit(chamber), F.lit(str(term)), "group_ext_id")
    return missing.select(F.sha2(natural, 256).alias("group_id"), F.lit(chamber).alias("chamber"), F.lit(term).alias("term"), "group_ext_id")


def section_fingerprint(section: DataFrame) -> DataFrame:
    """One row (n_rows, fingerprint): independent of row order and of how the section is split.

    Each row's sha256 is read as three numbers and summed; sums combine in any order, so nothing is gathered or sorted.
    """
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(section.columns)]), {"ignoreNullFields": "false"})
    digest = section.select(F.sha2(text, 256).alias("_h"))
    parts = [
        F.coalesce(F.sum(F.conv(F.substring("_h", 1 + 10 * i, 10), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
        for i in range(3)
    ]
    return digest.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


def manifest(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, n_rows, fingerprint) of a release."""
    out = None
    for name, df in sorted(sections.items()):
        row = section_fingerprint(df).select(F.lit(name).alias("section"), "n_rows", "fingerprint")
        out = row if out is None else out.unionByName(row)
    return out


def write_release(
    sections: dict[str, DataFrame], folder: str, version: str, check: Callable[[dict[str, DataFrame]], None] | None = None
) -> DataFrame:
    """Writes each section as JSON lines under folder/version, then the manifest computed from what was written. `check` sees
    the written sections first and may raise, which leaves the release without a manifest."""
    if not sections:
        raise ValueError("a release needs at least one section")
    spark = next(iter(sections.values())).sparkSession
    target = f"{folder}/{version}"
    for name, df in sections.items():
        df.write.mode("errorifexists").json(f"{target}/{name}")
    written = {name: spark.read.schema(df.schema).json(f"{target}/{name}") for name, df in sections.items()}
    if check:
        check(written)
    rows = manifest(written).withColumn("version", F.lit(version))
    rows.write.mode("errorifexists").json(f"{target}/manifest")
    return spark.read.schema(rows.schema).json(f"{target}/manifest")


def register_release(manifest_rows: DataFrame, path: str) -> int:
    """Adds the release to the registry unless its version is there."""
    release = manifest_rows.groupBy("version").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("sections"))
    return insert_if_absent(release, path, ["version"])


def save_documents(documents: DataFrame, paragraphs: DataFrame, folder: str) -> tuple[int, int]:
    """Documents and their paragraphs, with ids derived from content and reading version so that reruns add nothing.

    documents: sha256, extraction, ...; paragraphs: sha256, extraction, n, ...
    """
    ident = F.sha2(F.concat_ws("|", "sha256", F.col("extraction").cast("string")), 256)
    docs = insert_if_absent(documents.withColumn("document_id", ident), f"{folder}/documents", ["document_id"])
    pars = insert_if_absent(paragraphs.withColumn("document_id", ident), f"{folder}/paragraphs", ["document_id", "n"])
    return docs, pars


def programme_links(parties: DataFrame, readings: DataFrame) -> DataFrame:
    """(party_id, election, document_id): each party of a filed programme with the current reading of its file."""
    from tallyframe.operators.temporal import newest

    current = newest(readings, ["sha256"], [F.col("extraction").desc(), F.col("document_id")])
    listed = parties.select(F.explode("parties").alias("party_id"), "election", "sha256")
    return listed.join(current.select("sha256", "document_id"), "sha256").select("party_id", "election", "document_id").distinct()


def documents_to_reread(stored: DataFrame, listed: DataFrame, version: int) -> DataFrame:
    """Listed files never read, or read with an older extraction only."""
    best = stored.groupBy("sha256").agg(F.max("extraction").alias("_v"))
    return listed.join(best, "sha256", "left").filter(F.coalesce("_v", F.lit(0)) < version).drop("_v")


def inputs_to_process(batches: DataFrame, done: DataFrame, model: str, prompt: str) -> DataFrame:
    """Batches whose input was never processed with this model and prompt; equal inputs are processed once."""
    mine = done.filter((F.col("model") == model) & (F.col("prompt") == prompt))
    return batches.dropDuplicates(["input_sha"]).join(mine.select("input_sha"), "input_sha", "left_anti")


def reused_answers(batches: DataFrame, done: DataFrame, model: str, prompt: str) -> DataFrame:
    """Every batch whose input already has an answer, with that answer."""
    mine = done.filter((F.col("model") == model) & (F.col("prompt") == prompt)).groupBy("input_sha").agg(
        F.min("answer").alias("answer")
    )
    return batches.join(mine, "input_sha")
