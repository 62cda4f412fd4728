"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.llm.blocks import pairs_within
from tessela.llm.names import name_classes, similar_names, star_clusters
from tessela.session import cut_lineage, table

catalog = Catalog()
COLUMNS = {"professor": True, "board": False, "institution": False}


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    names, classes = name_classes(table(spark, d, "knowledge_assets"), COLUMNS)
    links = cut_lineage(similar_names(classes))
    return names.join(star_clusters(classes, links), ["field", "rep"]).select("field", "name", "centre")


@catalog.add("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    c = cut_lineage(_clusters(spark, d))
    return pairs_within(c, ["field", "centre"], "name").select("field", F.col("a").alias("name_a"), F.col("b").alias("name_b"))


@catalog.add("p5_clusters")
def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)
