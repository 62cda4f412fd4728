"""Sinks.  Each write can be run again with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.operators.joins import upsert


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes the partitions that the rows have; other partitions of the table stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def put_rows(spark: SparkSession, path: str, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Puts rows in the place of those with their key, the last by ``order`` of each; written beside and read back.

    The new version is a folder of its own, so a failure in between leaves the old one whole.  Returns the new version.
    """
    fs = _files(spark, path)
    versions = sorted(int(v[1:]) for v in fs if v.startswith("v") and v[1:].isdigit())
    cols = [c for c in rows.columns if c != order]
    if versions:
        base = spark.read.parquet(f"{path}/v{versions[-1]}")
    else:
        base = rows.select(*cols).limit(0)
    new = upsert(base.withColumn(order, F.lit(None).cast(dict(rows.dtypes)[order])), rows, key, order)
    target = f"{path}/v{versions[-1] + 1 if versions else 1}"
    new.write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def _files(spark: SparkSession, path: str) -> list[str]:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]


def delete_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among the given; rows without a key stay."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as compressed JSON lines in a folder of its own, and a manifest (table, rows) beside them, which is returned."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
        counts.append((name, spark.read.json(f"{path}/{name}", schema=df.schema).count()))
    manifest = spark.createDataFrame(counts, "`table` string, `rows` bigint")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest
