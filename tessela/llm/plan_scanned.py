"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.llm.scanned import repair_texts, train_on
from tessela.session import table

catalog = Catalog()
KEYS = ["src_table", "row_id"]


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    assets = table(spark, d, "asset_texts").where(F.col("model").isin("exam", "material")).select(F.lit("asset_texts").alias("src_table"), F.col("asset_id").alias("row_id"), F.col("conteudo_texto").alias("text"))
    chunks = table(spark, d, "chunk_vectors").select(F.lit("chunk_vectors").alias("src_table"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    texts = assets.unionByName(chunks)
    return repair_texts(texts, KEYS, "text", train_on(texts, "row_id", "text"))


@catalog.add("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select(*KEYS, F.explode("damage").alias("x")).select(*KEYS, "x.line_no", "x.kind").distinct()


@catalog.add("p4_repaired")
def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select(*KEYS, "repaired").dropDuplicates(KEYS)
