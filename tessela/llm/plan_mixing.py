"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.llm.mixing import mix, share_report
from tessela.llm.tokens import token_sizes
from tessela.session import cut_lineage, table

catalog = Catalog()


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    docs = table(spark, d, "documents").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    return cut_lineage(token_sizes(docs.select("source", "doc_id", "text"), "text")), targets


@catalog.add("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _parts(spark, d)
    return mix(sizes, targets.collect())


@catalog.add("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _parts(spark, d)
    return share_report(mix(sizes, targets.collect()), sizes, targets)


@catalog.add("p9_shares_all_tokens")
def p9_shares_all_tokens(spark: SparkSession, d: str) -> DataFrame:
    """As large a mix as all texts together: small sources are repeated up to their cap and then fall short."""
    sizes, targets = _parts(spark, d)
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    return share_report(mix(sizes, targets.collect(), total), sizes, targets)
