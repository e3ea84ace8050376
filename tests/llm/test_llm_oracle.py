"""Registered queries of this subpackage against their SQL."""

import compare
import pytest

from duecheck.llm import queries

SMALL = "/root/testdata/sf0.001"
ORACLES = queries.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return compare.oracle(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, connection, name):
    assert compare.difference(queries.queries()[name](spark, SMALL), connection, ORACLES[name]) is None
