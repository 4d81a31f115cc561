"""Observations made from the events table: each event is a record of an attraction, polled at the end of its six hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_HOURS = 6


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = BUCKET_HOURS * 3_600_000_000
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    begin = F.floor(us / micros) * micros
    day = F.to_date(F.timestamp_micros(begin))
    ride = F.col("user_id") % 10
    kind = F.when(F.col("event_type") == "signup", " Single Rider").when(F.col("event_type") == "purchase", " Parade").otherwise("")
    closed = (F.col("event_type") == "error") | ((ride == 3) & (F.datediff(day, F.lit("2024-01-01").cast("date")) % 3 == 0))
    rows = events.select(
        F.col("event_id").alias("src_row"),
        day.cast("string").alias("file_date"),
        F.timestamp_micros(begin + micros).alias("snapshot_ts"),
        F.timestamp_micros(us).alias("source_ts"),
        F.concat(F.lit("p"), F.col("user_id") % 2).alias("park_id"),
        F.concat(F.lit("Land "), F.col("user_id") % 3).alias("land"),
        ride.cast("string").alias("ride_id"),
        F.concat(F.lit("Coaster & Loop "), F.col("user_id") % 5, kind).alias("ride_name"),
        (~closed).alias("is_open"),
        F.when((ride == 4) | (F.col("value") < 2), 0.0).otherwise(F.floor("value").cast("double")).alias("wait"),
    )
    return rows
