"""Every registered query against its SQL (or for rows only) on the smallest tables."""
import os

import pytest
from check import compare, duck

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, err = compare(spark, con, QUERIES[name], ORACLE.get(name), SF)
    assert err is None, err
    assert rows >= 0


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
