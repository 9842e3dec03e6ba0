"""The registered queries that SQL can express, against their SQL."""

import pytest
from compare import connect, differences

import __spark_entry__ as registered
from windowmatch.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = registered.queries()[name](spark, SF)
    assert differences(got, connect(SF), registered.oracle_sql()[name]) is None
