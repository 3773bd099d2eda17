"""Every registered query on the smallest tables: against its SQL twin, or at least with rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from tests.oracle import connect, difference
from tunegrain.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_equals_sql(spark, con, name):
    assert difference(QUERIES[name].run(spark, FOLDER), con, QUERIES[name].sql) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_has_rows(spark, name):
    df = QUERIES[name].run(spark, FOLDER)
    rows = df.collect()
    assert rows and all(v is not None for v in rows[0])


def test_entry(spark):
    assert driver.entry(spark).columns == ["source", "target", "found", "distance", "hits", "path"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
