"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.llm.canonical import map_terms
from tessela.session import table

catalog = Catalog()


@catalog.add("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    terms, refs = table(spark, d, "terms"), table(spark, d, "canonical_terms")
    open_rows = terms.join(refs.select("canonical_term"), "canonical_term", "left_anti")
    return map_terms(open_rows, refs).select("id", F.coalesce("ref_id", F.lit(0)).cast("bigint").alias("ref_id"))


@catalog.add("p1_unmatched")
def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that match no entry, with how often each is typed."""
    terms = table(spark, d, "terms")
    mapped = map_terms(terms, table(spark, d, "canonical_terms"))
    missed = mapped.where("ref_id is null").select("id")
    return terms.join(missed, "id", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
