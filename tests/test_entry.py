"""The registered queries against their SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry_file
from checks import registry
from checks.compare import differences, sql_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return sql_tables(SF)


def test_entry(spark):
    rows = entry_file.entry(spark).collect()
    assert {r.year for r in rows} == {2021, 2022, 2023, 2025}


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry_file.queries()) and set(registry.ORACLES) <= set(entry_file.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, name, SF) is None
