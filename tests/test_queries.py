"""Every registered query against its SQL on the given tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as registered

SF_DIR = "/root/testdata/sf0.001"


def own():
    """Queries of the library itself; those of the llm subpackage are tested in tests/llm."""
    llm = {*registered.llm.queries(), "pipeline"} if registered.llm else set()
    return set(registered.queries()) - llm


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert own() <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(own()))
def test_query_equals_sql(spark, con, name):
    got = registered.queries()[name](spark, SF_DIR)
    assert differences(got, con, registered.oracle_sql()[name]) is None


def test_entry_returns_ten_hits(spark):
    rows = registered.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))
