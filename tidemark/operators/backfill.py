"""Storing the archive, the raw and the normalised observations: attractions, counts, and verification of what was stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import ANALYZER_VERSION, ZONE
from tidemark.operators.lineage import standby_analysis


def flag_array(flags: Column) -> Column:
    """Flags joined by bars as an array, without empty ones; null as none."""
    return F.filter(F.split(F.coalesce(flags, F.lit("")), r"\|"), lambda x: x != "")


def with_park(normalized: DataFrame, raw: DataFrame) -> DataFrame:
    """Normalised rows with the park of the raw row they come from."""
    return normalized.join(raw.select("raw_observation_id", "park_id"), "raw_observation_id")


def attractions(normalized: DataFrame, aliases: DataFrame) -> DataFrame:
    """(canonical_id, park_id, canonical_name, category): attractions of the rows and, going before them, of the aliases.

    Of several rows of one id the last counts: the aliases' last, else the rows' last by ``position``.
    """
    columns = ["park_id", "canonical_name", "category"]
    told = normalized.select("canonical_id", F.lit(0).alias("late"), "position", *columns).unionByName(aliases.select("canonical_id", F.lit(1).alias("late"), "position", *columns))
    last = told.groupBy("canonical_id").agg(F.max_by(F.struct(*columns), F.struct("late", "position")).alias("x"))
    return last.select("canonical_id", "x.*")


def standby_view(normalized: DataFrame, raw: DataFrame) -> DataFrame:
    """Normalised standby rows beside what the raw row says, for models of waits."""
    own = standby_analysis(normalized)
    return own.join(raw.select("raw_observation_id", *[c for c in raw.columns if c not in own.columns]), "raw_observation_id")


def of_archives(raw: DataFrame, archives: DataFrame) -> DataFrame:
    """Raw rows of the archives (raw_archive_id)."""
    return raw.join(archives.select("raw_archive_id").distinct(), "raw_archive_id", "left_semi")


def stored_counts(raw: DataFrame, normalized: DataFrame, archives: DataFrame, version: str = ANALYZER_VERSION) -> DataFrame:
    """One row: how many raw rows of the archives are stored, and how many normalised ones of this version."""
    mine = of_archives(raw, archives)
    met = normalized.where(F.col("transformation_version") == version).join(mine.select("raw_observation_id"), "raw_observation_id", "left_semi")
    return mine.agg(F.count(F.lit(1)).alias("raw_count")).join(met.agg(F.count(F.lit(1)).alias("normalized_count")), F.lit(True))


def require_stored(stored: DataFrame, raw_count: int, normalized_count: int) -> None:
    """An error unless the counts of ``stored_counts`` are the planned ones."""
    found = stored.first()
    if (found.raw_count, found.normalized_count) != (raw_count, normalized_count):
        raise ValueError(f"planned {raw_count} raw and {normalized_count} normalised rows, stored are {found.raw_count} and {found.normalized_count}")


def plan_counts(archives: DataFrame, raw: DataFrame, normalized: DataFrame, aliases: DataFrame, zone: str = ZONE) -> DataFrame:
    """One row: what a backfill is going to store. Counts are combined before they are shuffled."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    eligible = (F.col("access_mode") == "standby") & F.col("is_open") & F.col("observed_wait").isNotNull() & (F.col("training_eligibility") == "standby_wait_model")
    parts = [
        archives.agg(F.count(F.lit(1)).alias("raw_archives")),
        raw.agg(F.count(F.lit(1)).alias("raw_observations"), count(F.col("snapshot_timezone") != zone).alias("invalid_timezones")),
        normalized.agg(F.count(F.lit(1)).alias("normalized_observations"), F.countDistinct("file_date").alias("normalized_dates"), count(F.col("access_mode") == "single_rider").alias("single_rider"),
            count(eligible).alias("standby_analysis"), count(~F.col("is_open") & F.col("observed_wait").isNotNull()).alias("closed_with_wait")),
        aliases.agg(F.count(F.lit(1)).alias("aliases")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, F.lit(True))
    return out


def require_sound(counts: DataFrame) -> None:
    """An error if rows of ``plan_counts`` break an invariant."""
    found = counts.first()
    if found.closed_with_wait or found.invalid_timezones:
        raise ValueError(f"{found.closed_with_wait} closed rows with a wait, {found.invalid_timezones} rows of another time zone")
