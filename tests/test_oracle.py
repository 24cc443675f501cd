"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_registry():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert registry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF_DIR) is None


def test_whole_run(spark):
    rows = QUERIES["reconcile_all"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/part.parquet").count()
    assert any(r.purchase_assignment is not None for r in rows)
