"""Streaming queries, run over the events that are there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.catalog import Catalog
from tessela.session import shared_folder, table
from tessela.streaming import streams as s

catalog = Catalog()


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _ran(stream: DataFrame, mode: str = "append") -> DataFrame:
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    return s.run_to_table(stream, f"{folder}/out", f"{folder}/state", mode)


@catalog.add("stream_daily_counts", "select strftime(ts, '%Y-%m-%d') \"day\", event_type, count(*) n from events group by all")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return _ran(s.daily_counts(_events(spark, d), "ts", ["event_type"]), "complete")


@catalog.add("stream_session_counts", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end b from events),
    g as (select user_id, sum(b) over (partition by user_id order by ts rows unbounded preceding) g from e) select user_id, count(*) n from g group by user_id, g""")  # fmt: skip
def stream_session_counts(spark: SparkSession, d: str) -> DataFrame:
    return _ran(s.sessions(_events(spark, d), "ts", "user_id", "12 hours"), "complete").select("user_id", "n")


@catalog.add("stream_signal_state")
def stream_signal_state(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where(F.col("event_type").isin("error", "view")).withColumn("weight", F.when(F.col("event_type") == "error", 1.5).otherwise(1.0))
    return _ran(s.signal_states(e, "user_id", "ts", "weight")).select("key", "total", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("fired_at"))
