"""Every query with SQL gives the same rows as DuckDB."""

import pytest
from harness import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, sf_dir, connection):
    assert compare(QUERIES[name](spark, sf_dir), connection, ORACLE[name]) is None


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r.split for r in rows} == {"train", "val", "test"}
