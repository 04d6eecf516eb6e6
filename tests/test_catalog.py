"""Every registered query against its SQL on the smallest sample."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SAMPLE = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SAMPLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, SAMPLE).toPandas()
    if name in CHECKS:
        problem = difference(result, con.execute(CHECKS[name]).df())
        assert problem is None, problem
    else:
        assert len(result)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
