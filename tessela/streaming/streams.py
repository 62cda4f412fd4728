"""Streams: daily counters, windows, an idempotent queue and signals that add up until they fire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessela.sources.sinks import put_rows


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 10) -> DataFrame:
    """Parquet files as they arrive, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily_counts(events: DataFrame, ts: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """(day, keys, n): rows per day; rows later than the watermark are dropped."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return e.groupBy(F.window("_ts", "1 day").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *keys, "n")


def sliding_counts(events: DataFrame, ts: str, keys: list[str], size: str, step: str, late: str = "1 hour") -> DataFrame:
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return e.groupBy(F.window("_ts", size, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return e.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def signal_states(signals: DataFrame, key: str, ts: str, weight: str, threshold: float = 3.0, days: int = 90) -> DataFrame:
    """(key, total, at): a row each time the weights of a key reach the threshold; its signals are then used up.

    Signals older than ``days`` before the newest one don't count.  State is the list of open signals of one key, which
    the threshold keeps short.
    """
    s = signals.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(weight).cast("double").alias("weight")).withWatermark("at", f"{days} days")

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, weights = state.get if state.exists else ([], [])
        open_ = list(zip(times, weights))
        fired = []
        new = pd.concat(list(batches)).sort_values(["at", "weight"])
        for at, w in zip(new["at"], new["weight"]):
            us = int(at.value // 1000)
            open_ = [(t, x) for t, x in open_ if t > us - days * 86_400_000_000] + [(us, float(w))]
            total = sum(x for _, x in open_)
            if total >= threshold:
                fired.append((k[0], round(total, 6), at))
                open_ = []
        if open_:
            state.update(([t for t, _ in open_], [x for _, x in open_]))
            newest = max(t for t, _ in open_) // 1000 + days * 86_400_000
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(fired, columns=["key", "total", "at"])

    return s.groupBy("key").applyInPandasWithState(update, "key string, total double, at timestamp", "times array<bigint>, weights array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def drain_queue(actions: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Applies queued rows to a table, the last of each key; a batch that is run again changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            put_rows(batch.sparkSession, path, batch, key, order)

    return actions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs over all that is there now and returns what was written to the folder ``path``.

    Each batch has a folder of its own, in complete mode all have the same, so a batch that is run again changes nothing.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else f'b{n}'}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
