"""Every registered query runs on the smallest data, and gives its SQL's rows where it has SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
import check_queries

FOLDER = "/root/testdata/sf0.001"
BUILDERS, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_query(spark, con, name):
    df = BUILDERS[name](spark, FOLDER)
    got = check_queries.rows(df.columns, df.collect())
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == check_queries.rows(columns, cur.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
