"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessela.catalog import Catalog
from tessela.llm.packing import checked_sizes, fill_report, fixed_by_dominance, pack
from tessela.llm.tokens import token_sizes
from tessela.session import table

catalog = Catalog()


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, int]], DataFrame]:
    containers = [(r["container"], r["capacity_tokens"]) for r in table(spark, d, "token_containers").collect()]  # three, fixed
    sizes = checked_sizes(token_sizes(table(spark, d, "documents").select("doc_id", "text"), "text"))
    return pack(sizes, "doc_id", containers), containers, sizes


@catalog.add("p8_packing")
def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0]


@catalog.add("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    packed, containers, sizes = _packed(spark, d)
    return fill_report(packed, containers, fixed_by_dominance(sizes, containers))
