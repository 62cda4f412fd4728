"""References to records that do not exist.

References and parent keys are shuffled on the same key, sorted, and merged
linearly (a sort-merge join); each parent carries its validity interval, which
separates *missing*, *deleted* and *late*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.functions.text import key_of

#: A key with more than this share of all references is hot, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.005
#: Pieces into which the references of a hot key are cut.
SALTS = 64


def references(df: DataFrame, src_table: str, field: str, row_id: str, at: str, parent: str) -> DataFrame:
    """The references of one column; null and blank are none."""
    return df.select(
        F.lit(src_table).alias("src_table"), F.lit(field).alias("field"), F.col(row_id).alias("row_id"),
        F.lit(parent).alias("parent"), key_of(F.col(field)).alias("ref_key"), F.col(at).alias("ref_at"),
    ).where("ref_key is not null")


def parents(df: DataFrame, name: str, key: str, created: str = "created_at", deleted: str = "deleted_at", updated: str | None = None) -> DataFrame:
    """One row per key, of its latest version: (parent, ref_key, valid_from, deleted_at).

    Latest is by ``updated``, then ``created``; of ties a live version holds.
    """
    order: list[Column] = [F.col(updated)] if updated else []
    latest = F.struct(*order, F.col(created), F.col(deleted).isNull().alias("live"), F.col(deleted).alias("gone"))
    return (
        df.select(key_of(F.col(key)).alias("ref_key"), latest.alias("v"))
        .where("ref_key is not null")
        .groupBy("ref_key")
        .agg(F.max("v").alias("v"))
        .select(F.lit(name).alias("parent"), "ref_key", F.col(f"v.{created}").alias("valid_from"), F.col("v.gone").alias("deleted_at"))
    )


def orphans(refs: DataFrame, targets: DataFrame, hot_share: float = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """The references without a valid target, with ``reason`` and ``month``; each row once.

    A reference whose time is unknown is never late, nor is one whose target has no
    creation time.  Repeated references are one.  Empty inputs give empty results.

    References of a hot key are spread over ``salts`` merge ranges, to each of which that
    key's one parent row is copied; the set of hot keys has at most ``1 / hot_share`` rows,
    which bounds what is broadcast.
    """
    on = ["parent", "ref_key"]
    counts = refs.groupBy(*on).agg(F.count("*").alias("n"))
    total = refs.agg((F.count("*") * hot_share).alias("limit"))
    hot = counts.join(F.broadcast(total), F.col("n") > F.col("limit")).select(*on, F.lit(True).alias("hot"))
    salted = refs.join(F.broadcast(hot), on, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int")).otherwise(0)).drop("hot")
    copies = targets.join(F.broadcast(hot), on, "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    merged = salted.join(copies.withColumn("known", F.lit(True)).hint("merge"), [*on, "salt"], "left")
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("deleted_at").isNotNull(), "deleted").when(F.col("valid_from") > F.col("ref_at"), "late")
    return (
        merged.withColumn("reason", reason)
        .where("reason is not null")
        .select("src_table", "field", "row_id", "ref_key", "reason", F.date_format("ref_at", "yyyy-MM").alias("month"))
        .distinct()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans by table, field, month and reason."""
    return found.groupBy("src_table", "field", "month", "reason").agg(F.count("*").alias("orphans"), F.countDistinct("ref_key").alias("missing_keys"))
