"""Queries of this subpackage with the SQL that gives the same rows; None where SQL cannot express it in sensible time."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("host_rules", "jaccard", "decontamination", "mixing", "sharding", "shared_spans", "licenses", "line_spread", "interpolation", "transcripts", "personal_data", "collocations", "hard_negatives")


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tallyframe.llm.{name}")
