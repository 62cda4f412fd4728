"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.llm.neardup import duplicate_groups, duplicate_pairs, option_texts, similar_classes, word_classes
from tessela.session import cut_lineage, table

catalog = Catalog()
SIMILARITY = 0.6


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sets, members = word_classes(table(spark, d, "extracted_questions"), "id", [F.col("statement"), option_texts(F.col("options_json"))])
    return cut_lineage(sets), members


@catalog.add("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    sets, members = _classes(spark, d)
    return duplicate_pairs(similar_classes(sets, SIMILARITY), members)


@catalog.add("p2_groups")
def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    sets, members = _classes(spark, d)
    return duplicate_groups(cut_lineage(similar_classes(sets, SIMILARITY)), members)
