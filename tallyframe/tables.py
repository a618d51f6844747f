"""Stored tables that several writers and readers can rely on: appends that open only what may hold their keys, and writes of
several tables that become visible together."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "key_bucket"


class KeyedTable:
    """A table of rows with a natural key, in folders by the key's hash.

    An append looks for its keys only in the folders that they belong to, and only in the columns of the key: the number of
    folders is fixed, so the list of those a batch touches is short whatever the batch holds. Many small appends leave many
    small files; `compact` writes the folders anew.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        empty = spark.createDataFrame([], schema)
        self.columns = empty.columns
        self.schema = StructType([*empty.schema.fields, *spark.createDataFrame([], f"{BUCKET} int").schema.fields])

    def stored(self) -> DataFrame:
        """The rows with the folder they are in."""
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self.stored().select(*self.columns)

    def bucket(self) -> Column:
        # NULL is a value of a key like any other, which a hash alone would pass over
        parts = [c for k in self.keys for c in (F.col(k), F.col(k).isNull())]
        return F.pmod(F.xxhash64(*parts), F.lit(self.buckets)).cast("int")

    def may_hold(self, rows: DataFrame) -> DataFrame:
        """The keys stored in the folders that the rows' keys belong to."""
        touched = [r[BUCKET] for r in rows.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
        return self.stored().filter(F.col(BUCKET).isin(touched)).select(BUCKET, *self.keys)

    def absent(self, new: DataFrame, order: list[Column] | None = None) -> DataFrame:
        """The rows to append, with their folder: one per key that is not stored, the first under `order`."""
        from tallyframe.operators.temporal import newest

        once = newest(new.select(*self.columns), self.keys, order or [F.col(k) for k in self.keys]).withColumn(BUCKET, self.bucket())
        held = self.may_hold(once)
        held = held.select(*[F.col(c).alias(f"_{c}") for c in held.columns])
        same = F.col(BUCKET) == F.col(f"_{BUCKET}")
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return once.join(held, same, "left_anti")

    def append(self, new: DataFrame, order: list[Column] | None = None) -> int:
        """Appends the absent rows and returns how many there were. Doing it twice adds nothing the second time."""
        counted = Observation()
        # observed last: a stage that turns out empty is replaced, and takes what it observed with it
        rows = self.absent(new, order).repartition(F.col(BUCKET)).observe(counted, F.count(F.lit(1)).alias("n"))
        rows.write.mode("append").partitionBy(BUCKET).parquet(self.path)
        return counted.get["n"]

    def compact(self, target: str) -> KeyedTable:
        """The same rows in another folder, one file for each of the table's folders and task."""
        self.stored().repartition(F.col(BUCKET)).write.mode("errorifexists").partitionBy(BUCKET).parquet(target)
        return KeyedTable(self.spark, target, StructType(self.schema.fields[:-1]), self.keys, self.buckets)


class Ledger:
    """Several tables written together.

    A writer puts each table's rows in a folder of a fresh version, where no reader looks, and then commits the version: one
    row in one file, which is there or is not. Readers take the rows of committed versions alone, so what a failed writer left
    is never seen, and a reader sees all tables of a version or none.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root = spark, root
        self.schemas = {n: spark.createDataFrame([], f"{s}, version string").schema for n, s in schemas.items()}
        self.commit_schema = "version string, block string, tables array<string>"

    def begin(self) -> str:
        return uuid.uuid4().hex

    def stage(self, version: str, name: str, rows: DataFrame) -> None:
        columns = [c for c in self.schemas[name].names if c != "version"]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")

    def commit(self, version: str, block: str, tables: list[str]) -> None:
        missing = set(self.schemas) - set(tables)
        if missing:
            raise ValueError(f"version {version} lacks {sorted(missing)}")
        row = self.spark.range(1).select(
            F.lit(version).alias("version"), F.lit(block).alias("block"), F.array(*[F.lit(t) for t in sorted(tables)]).alias("tables")
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def write(self, block: str, tables: dict[str, Callable[[], DataFrame]]) -> str:
        """Stages every table and commits. Whatever stops it in between leaves the tables as they were."""
        version = self.begin()
        for name, rows in tables.items():
            self.stage(version, name, rows())
        self.commit(version, block, list(tables))
        return version

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.commit_schema).parquet(f"{self.root}/commits")
        except AnalysisException:
            return self.spark.createDataFrame([], self.commit_schema)

    def read(self, name: str) -> DataFrame:
        """The rows of all committed versions."""
        try:
            stored = self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}")
        except AnalysisException:
            stored = self.spark.createDataFrame([], self.schemas[name])
        return stored.join(self.commits().select("version"), "version", "left_semi").drop("version")
