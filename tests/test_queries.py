"""Every registered query against its SQL twin on the smallest driver tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks import ORACLES, QUERIES
from checks.compare import difference, sql_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["cell", "duration_metric", "optimal_alpha"] and out.count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in entry.oracle_sql():
        names, want = sql_rows(SF, entry.oracle_sql()[name])
        assert difference(df.columns, got, names, want) is None
