"""Every query of the library proper against its statement in DuckDB, and on damaged tables."""

from __future__ import annotations

import pytest

from tessela.plans import all_plans
from tests.helpers import oracle, rows, variant

CATALOG = all_plans()


@pytest.mark.parametrize("name", sorted(CATALOG.oracle))
def test_matches_oracle(spark, sf_dir, name):
    df = CATALOG.queries[name](spark, sf_dir)
    names, want = oracle(CATALOG.oracle[name], sf_dir)
    assert sorted(df.columns) == names
    assert rows(df) == want


@pytest.mark.parametrize("name", sorted(set(CATALOG.queries) - set(CATALOG.oracle)))
def test_runs(spark, sf_dir, name):
    """Queries that SQL cannot check run to their end, and again to the same rows; their values are checked on fixtures."""
    first = CATALOG.queries[name](spark, sf_dir)
    assert first.columns and rows(first) == rows(CATALOG.queries[name](spark, sf_dir))


@pytest.mark.parametrize("kind", ["clash", "empty", "nulls"])
@pytest.mark.parametrize("name", ["p3_found", "p3_report"])
def test_references_on_damaged_tables(spark, sf_dir, tmp_path, name, kind):
    d = variant(sf_dir, tmp_path / kind, kind)
    found = rows(CATALOG.queries[name](spark, d))
    assert found == oracle(CATALOG.oracle[name], d)[1]
    if kind == "clash":
        assert found == rows(CATALOG.queries[name](spark, sf_dir))


def test_entry_has_all_queries(spark):
    import __spark_entry__ as e

    assert set(CATALOG.queries) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
