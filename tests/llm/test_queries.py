"""The registered queries whose results SQL can tell, against it."""

import os

import pytest

from checks import compare
from topicflow.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, monkeypatch, name):
    monkeypatch.setitem(compare.QUERIES, name, queries.QUERIES[name])
    monkeypatch.setitem(compare.ORACLES, name, queries.ORACLES[name])
    assert compare.differences(spark, compare.sql_tables(SF), name, SF) is None
