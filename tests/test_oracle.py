"""Every registered query with SQL gives the SQL's rows at the smallest scale factor."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    text, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert text.startswith(("ok", "rows")), text


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["level", "period_start", "period_end", "source_units", "source_entry_count"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
