"""Every registered query against its SQL counterpart."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from shapeloom.plans import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(queries.queries()) == set(oracles.oracle_sql())
    assert set(queries.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_sql(spark, con, name):
    ours = entry.queries()[name](spark, SF_DIR).toPandas()
    assert compare(ours, con.execute(entry.oracle_sql()[name]).fetch_df()) == ""


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
