"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest
from check import oracle, spark_result

from __spark_entry__ import entry, oracle_sql, queries
from workload.oracles import ORACLES
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert spark_result(queries()[name](spark, FOLDER)) == oracle(FOLDER, oracle_sql()[name])


def test_entry(spark):
    assert entry(spark).columns == ["user_id", "event_type_cvq", "props100_cvq"]
