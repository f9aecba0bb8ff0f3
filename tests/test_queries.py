"""Every named query against its SQL in an independent engine."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    assert compare(df, con, ORACLE[name]) is None
    shown = df._jdf.queryExecution().toString()
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in shown
