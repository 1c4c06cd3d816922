"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import pytest
from conftest import SF
from oracle import compare, connect

from veilwright import catalogue

JOBS, SQL = catalogue.jobs(), catalogue.sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert compare(JOBS[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(JOBS) - set(SQL)))
def test_runs(spark, name):
    df = JOBS[name](spark, SF)
    assert df.columns and df.count() > 0


def test_names_follow_the_inventory():
    assert set(SQL) <= set(JOBS)
    assert all(n[0] in "abcdefg" and n.split("_")[0][1:].isdigit() for n in JOBS)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
