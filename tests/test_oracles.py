"""Every registered query of the ledger against its SQL in DuckDB."""

from __future__ import annotations

import pytest

from tallyfold.plans import oracles, queries
from tallyfold.streaming import queries as streams

from .conftest import DATA, rows

CASES = {**queries.QUERIES, **streams.QUERIES}
SQL = {**oracles.ORACLE_SQL, **streams.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got, want = CASES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(CASES) - set(SQL)))
def test_without_oracle(spark, name):
    assert CASES[name](spark, DATA).columns
