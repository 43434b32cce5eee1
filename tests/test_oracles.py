"""Every query with an oracle gives DuckDB's rows; every query without one runs."""

from __future__ import annotations

import pytest
from conftest import DATA

from lodestone.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(name, same_as_duckdb):
    same_as_duckdb(catalogue.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_runs(name, spark):
    df = catalogue.queries()[name](spark, f"{DATA}/sf0.001")
    assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)
