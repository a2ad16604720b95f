"""Every registered query with an oracle equals its DuckDB SQL on the small test data."""

import math

import pytest

import __spark_entry__ as entry
from tessera.plans import registry
from tessera.testing import compare

from .conftest import SF_SMALL

ORACLES = registry.oracles()
QUERIES = registry.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert 0 < df.count() <= 3 * 50
    assert df.columns == ["state", "distributor_name", "total_sales", "total_units", "distributor_rank"]


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    con = duck(SF_SMALL)
    diff = compare(QUERIES[key](spark, SF_SMALL), con, ORACLES[key])
    assert diff is None, f"{key}: {diff}"


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_gives_finite_rows(spark, key):
    rows = QUERIES[key](spark, SF_SMALL).collect()
    assert rows
    assert all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))
