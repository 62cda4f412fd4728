"""Every training-data query on tables with clashing columns, without rows, and with nulls in each column."""

from __future__ import annotations

import pytest

from tessela.llm import training_catalog
from tests.helpers import oracle, rows, variant

CATALOG = training_catalog()
NAMES = sorted(CATALOG.queries)


@pytest.fixture(scope="module")
def plain_rows(spark, sf_dir):
    kept: dict[str, list] = {}

    def get(name):
        if name not in kept:
            kept[name] = rows(CATALOG.queries[name](spark, sf_dir))
        return kept[name]

    return get


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, sf_dir, tmp_path, name):
    d = variant(sf_dir, tmp_path / "empty", "empty")
    df = CATALOG.queries[name](spark, d)
    assert rows(df) == []


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(spark, sf_dir, tmp_path, name, plain_rows):
    d = variant(sf_dir, tmp_path / "clash", "clash")
    assert rows(CATALOG.queries[name](spark, d)) == plain_rows(name)


@pytest.mark.parametrize("name", NAMES)
def test_nulls(spark, sf_dir, tmp_path, name):
    d = variant(sf_dir, tmp_path / "nulls", "nulls")
    found = rows(CATALOG.queries[name](spark, d))
    assert found or name.startswith(("p4_", "p9_"))
    if name in CATALOG.oracle:
        assert found == oracle(CATALOG.oracle[name], d)[1]


@pytest.mark.parametrize("name", [n for n in NAMES if n.endswith("_found")])
def test_found_rows_are_distinct(plain_rows, name):
    found = plain_rows(name)
    assert len(found) == len(set(found))
