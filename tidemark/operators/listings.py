"""The listings of a report, in their orders. A listing is sorted once, by range partitions; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import times

LAST_CHECKS = 30


def optimizer_order(ready: DataFrame) -> DataFrame:
    return ready.orderBy("snapshot_ts", "park_id", "canonical_id", "access_mode")


def snapshots_in_order(rows: DataFrame) -> DataFrame:
    """(file_date, snapshot_ts, parks): the parks that each snapshot has rows of, by time."""
    return rows.groupBy("file_date", "snapshot_ts").agg(F.sort_array(F.collect_set("park_id")).alias("parks")).orderBy("snapshot_ts", "file_date")


def last_checks(gaps: DataFrame, number: int = LAST_CHECKS) -> DataFrame:
    """The last checks of each file date, by time and park.

    The snapshots of a date are numbered from the last one on, one row each, and only the checks of as many snapshots are ranked.
    """
    snapshots = gaps.groupBy("file_date", "snapshot_ts").agg(F.count(F.lit(1)).alias("k"))
    after = F.sum("k").over(Window.partitionBy("file_date").orderBy(F.col("snapshot_ts").desc())) - F.col("k")
    late = gaps.join(snapshots.withColumn("after", after).where(F.col("after") < number).select("file_date", "snapshot_ts", "after"), ["file_date", "snapshot_ts"])
    nth = F.row_number().over(Window.partitionBy("file_date", "snapshot_ts").orderBy(F.col("park_id").desc()))
    return late.withColumn("nth", nth).where(F.col("after") + F.col("nth") <= number).drop("after", "nth").orderBy("file_date", "snapshot_ts", "park_id")


def single_riders_in_order(singles: DataFrame) -> DataFrame:
    return singles.orderBy("file_date", "park_id", "base")


def full_day_closed(rides: DataFrame) -> DataFrame:
    """Rides that were closed for almost all of their day, the most closed first."""
    return rides.where("possible_full_day_closed").orderBy("file_date", F.col("closed_ratio").desc(), "park_id", "ride_key")


def downtimes(rides: DataFrame) -> DataFrame:
    """Rides with downtimes, those with most changes of status first."""
    return rides.where("temporary_downtime").orderBy("file_date", F.col("transitions").desc(), "park_id", "ride_key")


def stale_in_order(stale: DataFrame) -> DataFrame:
    return stale.orderBy("file_date", F.col("max_age_tenths").desc(), "park_id", "ride_name")


def console_lines(summary: DataFrame, duplicates: DataFrame, singles: DataFrame, optimizer: DataFrame) -> DataFrame:
    """(file_date, line): what a run says about each date. ``duplicates`` has the groups' number of each date (file_date, duplicates)."""
    out = summary.join(duplicates, "file_date", "left").join(singles, "file_date", "left").join(optimizer, "file_date", "left")
    said = {"rows": "total_rows", "snapshots": "snapshots", "closed": "closed_rows", "zero": "zero_wait_rows", "stale": "stale_rows", "duplicates": "duplicates", "singleRiderUsable": "usable_groups", "optimizerReady": "ready_rows"}
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(v), F.lit(0)).cast("string")) for k, v in said.items()]
    return out.select("file_date", F.concat("file_date", F.lit(": "), F.concat_ws(" ", *parts)).alias("line"))


def local_checks(checks: DataFrame, zone: str) -> DataFrame:
    """Checks with the local time of their snapshot."""
    return checks.withColumn("snapshot_local", times.local_text(F.col("snapshot_ts"), zone))
