"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.llm.vectors import ListParams, nearest, usable
from tessela.session import table

catalog = Catalog()
K = 5


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    p = ListParams()
    return nearest(usable(table(spark, d, "chunk_vectors"), "id", "asset_id", "vector", p.dimension), K, p)


@catalog.add("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


@catalog.add("p6_neighbours")
def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("id", "other", F.round(F.col("similarity").cast("double"), 4).alias("similarity"))
