"""Structured Streaming over the event table: the same transformations serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, path: str, glob: str = "events*.parquet", late: str = "10 minutes") -> DataFrame:
    """Events as a stream of files, with a watermark."""
    e = spark.readStream.schema(SCHEMA).option("pathGlobFilter", glob).parquet(path)
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(e: DataFrame, size: str = "1 hour") -> DataFrame:
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(e: DataFrame, size: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return e.groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"))


def sessions(e: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def distinct_events(e: DataFrame) -> DataFrame:
    return e.dropDuplicatesWithinWatermark(["event_id"]) if e.isStreaming else e.dropDuplicates(["event_id"])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new over those of old by key; a null doesn't replace a value."""
    n = new.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in old.columns if c != key])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in old.columns if c != key])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(_events(spark, sf_dir)).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(_events(spark, sf_dir)).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(_events(spark, sf_dir)).select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


QUERIES = {f.__name__: f for f in (event_windows, event_sliding, event_sessions)}
ORACLES = {
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "event_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1",
    "event_sessions": "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT min(ts) AS start, user_id, count(*) AS n FROM b GROUP BY user_id, s",
}
