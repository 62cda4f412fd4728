"""All pairs within groups, a group with many members block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a group that one task pairs with the others.
BLOCK = 1_000


def pairs_within(df: DataFrame, groups: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """(*groups, a, b): the pairs of distinct members of each group, a < b; null members have none.

    The members of a group are cut into blocks by a hash; each block is joined with the whole group, so that no task
    holds more pairs than ``block`` times the group.
    """
    rows = df.where(F.col(member).isNotNull()).select(*groups, F.col(member).alias("m")).distinct()
    counts = rows.groupBy(*groups).agg(F.count("*").alias("c")).where("c > 1").select(*groups, F.ceil(F.col("c") / block).cast("int").alias("c"))
    split = rows.join(counts, groups)
    a = split.select(*groups, F.col("m").alias("a"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("c"))
    b = split.select(*groups, F.col("m").alias("b"), F.pmod(F.xxhash64("m"), "c").cast("int").alias("c"))
    return a.join(b, [*groups, "c"]).where("a < b").select(*groups, "a", "b")
