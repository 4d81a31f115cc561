"""Content-addressed records, validation, lineage from cleaned rows to raw ones, and writes that can be repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ANALYZER_VERSION, RAW_VERSION, ZONE
from tidemark.functions import numbers
from tidemark.operators.ordered import Ordered

# What a raw row must have, what makes two rows the same observation, and the access modes there are.
REQUIRED = ["snapshot_utc", "snapshot_park_date", "snapshot_timezone", "park_id", "ride_id", "ride_name", "is_open", "source_last_updated_utc", "source_url"]
IDENTITY = ["snapshot_utc", "park_id", "ride_id", "ride_name", "source_last_updated_utc", "source_url"]
ACCESS_MODES = ["standby", "single_rider", "virtual_queue"]


def content_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts).cast("binary"), 256)


def archives(files: DataFrame) -> DataFrame:
    """(path, raw_archive_id, byte_size, source_name, schema_version) of whole files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("raw_archive_id"), F.length("content").cast("long").alias("byte_size"), F.regexp_extract("path", "([^/]+)$", 1).alias("source_name"), F.lit(RAW_VERSION).alias("schema_version"))


def object_uri(base: Column, archive: Column, name: Column) -> Column:
    """Where an archive lies under an assumed base (s3, gs or az), by its hash."""
    root = F.when(base.rlike(r"^(s3|gs|az)://"), F.regexp_replace(base, "/$", "")).otherwise(F.raise_error(F.concat(F.lit("not an object store: "), base)).cast("string"))
    return F.concat_ws("/", root, F.lit("wait-times"), archive, name)


def problems(raw: DataFrame, zone: str = ZONE) -> DataFrame:
    """(file_date, src_row, missing, wrong_zone) of the rows that lack a required value or are of another zone."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", c) for c in REQUIRED]))
    wrong = F.coalesce(F.col("snapshot_timezone") != zone, F.lit(True))
    return raw.select("file_date", "src_row", missing.alias("missing"), wrong.alias("wrong_zone")).where("size(missing) > 0 or wrong_zone")


def require_valid(raw: DataFrame) -> DataFrame:
    """``raw`` as it is, or an error that names the first wrong row. One row goes to the driver at most."""
    first = problems(raw).orderBy("file_date", "src_row").first()
    if first:
        raise ValueError(f"{first.file_date}, row {first.src_row}: missing {first.missing}, other time zone: {first.wrong_zone}")
    return raw


def with_ordinal(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with their number within the keys, from 1; a key's rows may be spread over many partitions."""
    return Ordered(rows, keys, order).ordinal("ordinal").frame()


def raw_records(raw: DataFrame, archive: Column, number: Column) -> DataFrame:
    """Typed raw observations with ids that follow from the archive and the row's number in it."""
    return raw.withColumns(
        {
            "raw_observation_id": content_id(archive, number.cast("string")),
            "snapshot_ts": F.to_timestamp("snapshot_utc"),
            "source_ts": F.to_timestamp("source_last_updated_utc"),
            "open": numbers.strict_bool(F.col("is_open"), "is_open"),
            "wait": numbers.strict(F.col("wait_time_minutes"), "wait_time_minutes"),
        }
    )


def access_mode(mode: Column) -> Column:
    return F.when(mode.isin(ACCESS_MODES), mode).otherwise("other")


def matched(cleaned: DataFrame, raw: DataFrame, keys: list[str] | None = None, order: str | list[str] = "src_row", raw_id: Column | None = None) -> DataFrame:
    """Cleaned rows with the ``raw_observation_id`` they come from: equal keys, the n-th to the n-th. Rows without one have null.

    ``raw_id`` gives the id from columns of ``raw`` among the keys and the order; without it the column of that name is taken.
    Both sides are dealt by the keys together, once: the numbers and then the ids are windows over rows that lie together already,
    unless a key is heavy. An id that follows from the order isn't shuffled, and no column is twice.
    """
    keys, order = keys or IDENTITY, [order] if isinstance(order, str) else order
    taken = [] if raw_id is not None else ["raw_observation_id"]
    ours = cleaned.drop("raw_observation_id", "ordinal").withColumn("_raw", F.lit(False))
    theirs = raw.select(*dict.fromkeys([*keys, *order, *taken])).withColumn("_raw", F.lit(True))
    both = Ordered(ours.unionByName(theirs, allowMissingColumns=True), [*keys, "_raw"], order, dealt=keys).ordinal("ordinal").frame()
    if raw_id is not None:
        both = both.withColumn("raw_observation_id", F.when(F.col("_raw"), raw_id))
    here = F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in keys]), F.max("raw_observation_id").over(Window.partitionBy(*keys, "ordinal")))
    columns = [c for c in ours.columns if c not in keys and c != "_raw"]
    return both.withColumn("raw_observation_id", here).where("not _raw").select(*keys, "ordinal", *columns, "raw_observation_id")


def normalized_ids(rows: DataFrame, version: str = ANALYZER_VERSION) -> DataFrame:
    return rows.withColumn("normalized_observation_id", content_id(F.col("raw_observation_id"), F.lit(version)))


def missing_dates(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    return raw.select("file_date").distinct().join(cleaned.select("file_date").distinct(), "file_date", "left_anti")


def violations(rows: DataFrame) -> DataFrame:
    """Counts of rows that break an invariant: closed with an observed wait, without a parent, a negative age, an unknown mode."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        count(~F.col("is_open") & F.col("observed_wait").isNotNull()).alias("closed_with_wait"),
        count(F.col("age_ms") < 0).alias("negative_age"),
        count(~F.col("access_mode").isin(ACCESS_MODES)).alias("unknown_mode"),
        count(F.col("access_mode") == "single_rider").alias("single_rider"),
    )


def to_insert(new: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``new`` whose key isn't stored, the first by ``order`` for each key: what a repeated write still has to add."""
    fresh = new.join(stored.select(*keys).distinct(), keys, "left_anti")
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*fresh.columns), order).alias("_first")).select("_first.*")


def reconciled(planned: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """One row: planned and stored numbers of keys, and whether all planned ones are there."""
    plan, have = planned.select(*keys).distinct(), stored.select(*keys).distinct().withColumn("_have", F.lit(True))
    both = plan.join(have, keys, "left")
    return both.agg(F.count(F.lit(1)).alias("planned"), F.count("_have").alias("stored")).withColumn("complete", F.col("planned") == F.col("stored"))


def standby_analysis(normalized: DataFrame) -> DataFrame:
    """Rows that a model of standby waits is made from."""
    return normalized.where("access_mode = 'standby' and is_open and observed_wait is not null and training_eligibility = 'standby_wait_model'")
