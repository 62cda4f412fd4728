"""Sorts, limits, paging and windowed picks.  Every order ends in a key, so results are the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], offset: int, n: int) -> DataFrame:
    """Rows offset .. offset + n of an explicit order, each with the number of all rows (``total``)."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(n).join(F.broadcast(total))


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key.  A key with very many rows is pre-cut in salted parts, so that no task sorts it whole."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(32))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    cut = df.withColumn("_s", salt).withColumn("_r", rank(*keys, "_s")).where(F.col("_r") <= n).drop("_s", "_r")
    return cut.withColumn("_r", rank(*keys)).where(F.col("_r") <= n).drop("_r")


def budget_prefix(df: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The rows of each group up to the first that would exceed the budget; the first row always.  Adds ``used``.

    Costs aren't negative.  A group with very many rows is pre-cut in salted parts: what a part alone makes exceed the
    budget, but for the first such row, isn't needed, so that no task sums up such a group.
    """
    part = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    costed = df.withColumn("_c", cost).withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(32)))
    cut = costed.withColumn("_u", F.sum("_c").over(part(*group, "_s"))).where(F.col("_u") - F.col("_c") <= budget).drop("_s", "_u")
    run = cut.withColumn("used", F.sum("_c").over(part(*group))).withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return run.where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n", "_c")


def streaks(df: DataFrame, group: list[str], day: str) -> DataFrame:
    """(group, first_day, last_day, days): runs of consecutive days on which a group has a row."""
    days = df.select(*group, day).where(F.col(day).isNotNull()).distinct()
    n = F.row_number().over(Window.partitionBy(*group).orderBy(day))
    return days.withColumn("_i", F.date_sub(day, n)).groupBy(*group, "_i").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("_i")


def current_streak(df: DataFrame, group: list[str], day: str, today: str, most: int = 365) -> DataFrame:
    """(group, streak): consecutive days back from today, which may itself be without a row; 0 for a broken streak."""
    t = F.to_date(F.lit(today))
    ends = F.max(F.when(F.col("last_day").between(F.date_sub(t, 1), t), F.least(F.col("days"), F.lit(most))))
    return streaks(df.where(F.col(day) <= t), group, day).groupBy(*group).agg(F.coalesce(ends, F.lit(0)).cast("bigint").alias("streak"))


def dense_calendar(df: DataFrame, day: str, today: str, days: int = 60) -> DataFrame:
    """(day, n): rows per day of the last days, zero-filled."""
    t = F.to_date(F.lit(today))
    calendar = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(t, days - 1), t)).alias("day"))
    counts = df.where(F.col(day).between(F.date_sub(t, days - 1), t)).groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def bursts(df: DataFrame, group: list[str], ts: str, key: str, least: int, seconds: int) -> DataFrame:
    """Rows at which their group had at least so many rows in the last seconds, with the count.

    Time is cut into pieces of that length; a row is counted in its own piece and lent to the next one, so a group with
    very many rows is spread over as many tasks as it has pieces.
    """
    span = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.where(F.col(ts).isNotNull()).select(*group, key, at.alias("_at")).withColumn("_own", F.floor(F.col("_at") / span))
    lent = rows.withColumn("_piece", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(*group, "_piece").orderBy("_at").rangeBetween(-span, 0)
    return lent.withColumn("in_window", F.count("*").over(w)).where((F.col("_piece") == F.col("_own")) & (F.col("in_window") >= least)).select(*group, key, "in_window")


def repeated_run(df: DataFrame, group: list[str], order: list[Column], value: str, length: int = 3) -> DataFrame:
    """Rows that end a run of at least ``length`` equal values."""
    w = Window.partitionBy(*group).orderBy(*order)
    same = F.lit(True)
    for k in range(1, length):
        same = same & (F.lag(value, k).over(w) == F.col(value))
    return df.withColumn("_same", F.coalesce(same, F.lit(False))).where("_same").drop("_same")


def even_split(df: DataFrame, group: list[str], key: list[str], order: list[Column], total: int) -> DataFrame:
    """Adds ``quota``: the total shared out evenly over the rows of a group, the rest to the first ones.

    Only the first ``total`` rows of a group can get a share of the rest, so only these are ranked; ``key`` tells rows apart.
    """
    names = [f"_g{i}" for i in range(len(group))]
    n = df.groupBy(*[F.col(g).alias(x) for g, x in zip(group, names)]).agg(F.count("*").alias("_n"))
    first = best_per_key(df, group, order, total).withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_i")
    same = lambda a, b: [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)]
    out = df.join(n, same(group, names)).join(first, same(key, [f"_k{i}" for i in range(len(key))]), "left")
    more = F.when(F.col("_i") <= F.lit(total) % F.col("_n"), 1).otherwise(0)
    return out.withColumn("quota", (F.floor(F.lit(total) / F.col("_n")) + more).cast("bigint")).select(*df.columns, "quota")
