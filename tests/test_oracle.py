"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import pytest

import __spark_entry__ as entry
from hopline.plans import catalog
from tools.compare_oracle import compare, duck
from tests.conftest import SF_SMALL

NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries()) and set(catalog.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], SF_SMALL)
    assert r["schema"], r["cols"]
    assert r["rows"][0] == r["rows"][1]
    assert r["values"], r["diff"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["measurement", "spout_component", "spout_task", "sink_component", "sink_task", "value",
                          "ms_latency_ms", "path"]
