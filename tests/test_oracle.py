"""Every registered query against its oracle."""

import compare
import pytest
from frames import SMALL

import __spark_entry__ as entry
from duecheck.plans import queries
from oracle import queries as sql

QUERIES = queries.queries()
ORACLES = sql.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return compare.oracle(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert compare.difference(QUERIES[name](spark, SMALL), connection, ORACLES[name]) is None


BEYOND_BROADCAST = [n for n in QUERIES if n[0] in "dem" or n.startswith("volume") or n in ("k6_attach_memos", "r3_headline_money", "r7_customer_ranking")]


@pytest.mark.parametrize("name", sorted(BEYOND_BROADCAST))
def test_query_with_shuffled_joins(spark, connection, shuffled, name):
    assert compare.difference(QUERIES[name](spark, SMALL), connection, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
