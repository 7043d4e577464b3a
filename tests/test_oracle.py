"""Every query with an oracle matches DuckDB on the smallest fixture (sf0.001).

The driver runs the same comparison at sf0.01 (``tests/oracle_check.py``).
"""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck, rows_of_duck, rows_of_spark

from paths import SF_SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_registered_with_callable():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 50


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["country", "prevalence"]
    assert len(rows) == 25


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    cols_s, rows_s = rows_of_spark(QUERIES[name](spark, SF_SMALL))
    cols_d, rows_d = rows_of_duck(con, SQL[name])
    assert cols_s == cols_d
    status, why = compare(rows_s, rows_d)
    assert status in ("exact", "approx"), why
