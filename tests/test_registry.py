"""Every registry key against its DuckDB twin on the smallest driver tables,
plus the driver's smoke entry."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck
from stationflow.plans import registry

SF = "/root/testdata/sf0.001"
KEYS = sorted(registry.QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["STATION_ID", "STATION_NAME", "ADDRESS", "LAT", "LON", "BROKEN_DOCKS"]


def test_every_key_has_sql(spark):
    assert set(registry.QUERIES) == set(registry.ORACLE)
    assert set(registry.QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, key):
    ok, msg = compare(E.queries()[key](spark, SF).toPandas(), duck(E.oracle_sql()[key], SF))
    assert ok, msg
