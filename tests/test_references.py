from __future__ import annotations

import datetime as dt

from tessela.operators.references import orphan_report, orphans, parents, references
from tests.helpers import rows

T = dt.datetime(2024, 1, 1)
REF = "id string, k string, at timestamp"
PAR = "id string, created_at timestamp, deleted_at timestamp, updated_at timestamp"


def _refs(spark, data):
    return references(spark.createDataFrame(data, REF), "t", "k", "id", "at", "p")


def _parents(spark, data):
    return parents(spark.createDataFrame(data, PAR), "p", "id", updated="updated_at")


def test_missing_deleted_late(spark):
    day = dt.timedelta(days=1)
    par = _parents(spark, [("A", T, None, T), ("b", T, T + day, T + day), ("b", T, None, T), ("c", T, T, T), ("c", T, None, T + day), ("d", T + day, None, T + day)])
    refs = _refs(spark, [("1", " a ", T), ("2", "B", T), ("3", "c", T), ("4", "d", T), ("5", "zz", T), ("6", None, T), ("7", "  ", T), ("8", "d", None), ("5", "zz", T)])
    found = orphans(refs, par)
    assert {(r["row_id"], r["reason"]) for r in found.collect()} == {("2", "deleted"), ("4", "late"), ("5", "missing")}
    assert orphan_report(found).agg({"orphans": "sum"}).first()[0] == 3


def test_hot_key_is_split_with_the_same_result(spark):
    data = [(str(i), "hot" if i % 3 else f"k{i}", T) for i in range(3000)]
    par = _parents(spark, [(f"k{i}", T, None, T) for i in range(0, 3000, 2)])
    refs = _refs(spark, data)
    split, whole = orphans(refs, par), orphans(refs, par, hot_share=2.0)
    assert rows(split) == rows(whole)
    assert split.count() == 2000 + 500


def test_empty(spark):
    assert orphans(_refs(spark, []), _parents(spark, [])).count() == 0
    assert orphans(_refs(spark, [("1", "a", T)]), _parents(spark, [])).count() == 1
