import os
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from haulframe.llm import quality
from haulframe.llm.queries import QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert {n for n, (_, sql) in QUERIES.items() if sql} <= set(oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no shared tables")
@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, name):
    run, sql = QUERIES[name]
    assert compare(spark, connect(FOLDER), FOLDER, run, sql)["problems"] == []


def test_statistics_are_named_in_the_order_of_the_fit(spark):
    assert list(quality.statistics(F.lit(""))) == quality.NAMES
