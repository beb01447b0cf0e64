"""Every registered query at the smallest scale, against its DuckDB statement if it has one."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    statement = entry.oracle_sql().get(name)
    if statement is None:
        assert df.count() > 0
        return
    problem = compare(df, con, statement)
    assert problem in (None, "both empty"), problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["query_id", "position", "record_id"]
    assert df.count() > 0
