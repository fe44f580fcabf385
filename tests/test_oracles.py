"""Every query against its SQL on the smallest tables, and the contract of the entry module."""

import pytest
from compare import difference

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = {n for n in QUERIES if QUERIES[n].__module__.startswith("planloom.queries")}


@pytest.mark.parametrize("name", sorted(CORE & set(SQL)))
def test_same_as_sql(spark, sf_dir, name):
    assert difference(spark, QUERIES[name], SQL[name], sf_dir) == ""


def test_entry(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in CORE - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
