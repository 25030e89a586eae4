"""Every registered query of the engine against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from dependra.plans import catalog
from tests import helpers as H

SF = "sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, f"/root/testdata/{SF}")
    got = df.toPandas()
    if name in catalog.ORACLES:
        want = H.oracle(catalog.ORACLES[name], SF)
        assert sorted(got.columns) == sorted(want.columns)
        assert H.rows_of(got, got.columns) == H.rows_of(want, want.columns)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(x, str) for x in entry.oracle_sql().values())
