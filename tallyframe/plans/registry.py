"""Registry of runnable queries and of the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyframe.plans import domain


@dataclass(frozen=True)
class Query:
    build: Callable[[domain.Domain], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[domain.Domain], DataFrame]):
        QUERIES[name] = Query(build, with_views(oracle) if oracle else None)
        return build

    return register


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: q.build(domain.Domain(spark, sf_dir))


def with_views(body: str) -> str:
    """Prefixes the WITH list of the shared and the oracle-only views the text names, in dependency order."""
    views = {**domain.SHARED, **domain.ORACLE}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(views[name])
                if name not in order:
                    order.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} AS ({domain.plain(views[n])})" for n in order)
    body = body.strip()
    if not order:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
