"""Every registered query with a SQL twin, next to DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

_QUERIES, _SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_names_match():
    assert set(_SQL) <= set(_QUERIES)


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_equals_sql(spark, duck, folder, name):
    ok, message = compare(spark, duck, folder, _QUERIES[name], _SQL[name])
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
