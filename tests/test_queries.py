"""Every registered engine query against its SQL, at the smallest scale."""

import os

import pytest

from tests.compare import compare, connect
from tidemark.plans import exchange
from tidemark.plans.oracle import ORACLE as ENGINE
from tidemark.plans.queries import QUERIES

ORACLE = ENGINE | exchange.ORACLE
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLE[name], SF) is None


def test_all_bars_are_compounded(spark):
    got = QUERIES["q_compound_return_all"](spark, SF)
    assert got.count() == QUERIES["q_bars"](spark, SF).count() and got.filter("log_growth is null").count() == 0


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
