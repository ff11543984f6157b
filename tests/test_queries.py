"""Every query that has SQL gives the SQL's rows on the smallest tables; the others run."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import spark_rows, sql_rows, views

SF = "/root/testdata/sf0.001"
OWN = {n: q for r in entry.REGISTRIES for n, q in r.queries.items()}
SQL = {n: s for r in entry.REGISTRIES for n, s in r.sql.items()}


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert spark_rows(OWN[name](spark, SF)) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_runs(spark, name):
    assert OWN[name](spark, SF).count() > 0


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(OWN) <= set(entry.queries())
