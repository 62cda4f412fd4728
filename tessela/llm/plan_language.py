"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.llm.language import label_code, main_language, segments, train_on
from tessela.session import table

catalog = Catalog()


def _read(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    read = segments(docs, train_on(docs), "doc_id", "text")
    return read.withColumn("label", label_code(F.col("lang"))).withColumn("main", main_language(F.col("segs"))).withColumn("langs", F.size(F.array_distinct(F.transform("segs", lambda s: s["lang"]))))


@catalog.add("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    open_ = _read(spark, d).where("label is null or label != main or langs > 1")
    return open_.select("doc_id", F.explode("segs").alias("s")).select("doc_id", "s.seg_no", "s.lang")


@catalog.add("p10_documents")
def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its main language, the confidence of its segments weighted by bytes, and its languages."""
    n = F.aggregate("segs", F.lit(0.0), lambda a, s: a + s["n"])
    sure = F.aggregate("segs", F.lit(0.0), lambda a, s: a + s["n"] * s["confidence"]) / n
    return _read(spark, d).select("doc_id", "label", F.col("main").alias("language"), F.round(F.when(n > 0, sure), 3).alias("confidence"), F.array_sort(F.array_distinct(F.transform("segs", lambda s: s["lang"]))).alias("languages"))


@catalog.add("p10_segments")
def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments of the documents in several languages, with their confidence."""
    mixed = _read(spark, d).where("langs > 1").select("doc_id", F.explode("segs").alias("s"))
    return mixed.select("doc_id", "s.seg_no", "s.lang", F.round("s.confidence", 3).alias("confidence"))
