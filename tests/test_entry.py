"""Driver queries against their SQL on the small tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog import ALL
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no shared tables")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_flagship(spark):
    rows = entry(spark).collect()
    assert len(rows) > 0


def test_every_query_has_sql():
    assert set(ALL) <= set(queries())
    assert set(ALL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_equals_its_sql(spark, db, name):
    out = compare(spark, db, FOLDER, queries()[name], oracle_sql()[name])
    assert out["problems"] == []
