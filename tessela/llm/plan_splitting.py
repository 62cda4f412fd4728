"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.llm.splitting import pieces, split_spans
from tessela.session import table

catalog = Catalog()
KEYS = ["src_table", "row_id"]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    assets = table(spark, d, "asset_texts").where(F.col("model").isin("book", "exam")).select(F.lit("asset_texts").alias("src_table"), F.col("asset_id").alias("row_id"), F.col("conteudo_texto").alias("text"))
    chunks = table(spark, d, "chunk_vectors").select(F.lit("chunk_vectors").alias("src_table"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    return assets.unionByName(chunks)


@catalog.add(
    "p7_found",
    """select distinct src_table, row_id from (
    select 'asset_texts' src_table, asset_id row_id, conteudo_texto t from asset_texts where model in ('book', 'exam')
    union all select 'chunk_vectors', id, content from chunk_vectors) where length(t) > 2000""",
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return split_spans(_texts(spark, d), KEYS, "text").where("piece_no = 2").select(*KEYS).distinct()


@catalog.add("p7_pieces")
def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces(_texts(spark, d), KEYS, "text")
