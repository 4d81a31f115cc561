"""What a quality report says: summaries, duplicates and conflicts, stale sources, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import times
from tidemark.operators.observations import has_flag, is_stale
from tidemark.operators.ordered import Ordered
from tidemark.workspace import Workspace

# What is recommended, in this order; the last one always.
ADVICE = {
    "stale": "Exclude stale_source rows from wait-time training until the source timestamp becomes fresh again.",
    "duplicates": "Add duplicate ride names to the future canonical attraction mapping review list.",
    "conflicts": "Review canonical conflict groups and choose the freshest eligible row for downstream optimizer inputs.",
    "availability": "Keep Single Rider availability, but do not use all-zero Single Rider waits as optimizer wait-time weights.",
    "always": "Use observed_wait_time_minutes as the modeling target; raw wait_time_minutes remains available for audits.",
}


def _count(what: Column) -> Column:
    return F.count_if(F.coalesce(what, F.lit(False)))


def _states() -> dict[str, Column]:
    return {"closed_rows": _count(~F.col("is_open")), "zero_wait_rows": _count(F.col("wait") == 0), "open_zero_rows": _count(F.col("is_open") & (F.col("wait") == 0))}


def _named(found: dict[str, Column]) -> list[Column]:
    return [v.alias(k) for k, v in found.items()]


def _distinct(rows: DataFrame, by: list[str], name: str, *columns: str) -> DataFrame:
    """How many distinct values of the columns each group has: distinct rows first, then their number. Only these columns are read and shuffled."""
    return rows.select(*by, *columns).na.drop(subset=list(columns)).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def summary(cleaned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per file date: rows, distinct snapshots, rides and attractions, and rows by state and use.

    Each distinct count has an aggregation of its own, so no row is multiplied by the number of counts. The few columns that they
    read are written once.
    """
    columns = ["file_date", "snapshot_ts", "park_id", "ride_key", "canonical_id", "training_eligibility", "is_open", "wait", "age_ms", "is_single_rider", "is_entertainment"]
    cleaned = Workspace(cleaned.sparkSession, "summary").table(cleaned.select(*columns), "rows")
    use = lambda x: _count(F.col("training_eligibility") == x)
    others = {"stale_rows": _count(is_stale(settings)), "single_rider_rows": _count(F.col("is_single_rider")), "entertainment_rows": _count(F.col("is_entertainment"))}
    uses = {"standby_model_rows": use("standby_wait_model"), "status_only_rows": use("status_model_only")}
    out = cleaned.groupBy("file_date").agg(F.count(F.lit(1)).alias("total_rows"), *_named(_states() | others | uses))
    distinct = {"snapshots": ["snapshot_ts"], "rides": ["park_id", "ride_key"], "canonical_attractions": ["canonical_id"]}
    for name, columns in distinct.items():
        out = out.join(_distinct(cleaned, ["file_date"], name, *columns), "file_date", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select("file_date", "total_rows", *distinct, *_states(), *others, *uses)


def park_summary(cleaned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return cleaned.groupBy("file_date", "park_id").agg(F.count(F.lit(1)).alias("total_rows"), F.countDistinct("snapshot_ts").alias("snapshots"), *_named(_states()), _count(is_stale(settings)).alias("stale_rows"))


def snapshot_park_summary(cleaned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per local time of the snapshot and park; instants that read the same on the local clock are one."""
    local = times.local_text(F.col("snapshot_ts"), settings.zone)
    return cleaned.groupBy("file_date", local.alias("snapshot_local"), "park_id").agg(F.count(F.lit(1)).alias("total_rows"), *_named(_states()))


def parks_by_snapshot(summary: DataFrame) -> DataFrame:
    """(file_date, snapshot_local, parks): the rows of ``snapshot_park_summary`` as a map from park to counts."""
    counts = F.struct(*[c for c in summary.columns if c not in ("file_date", "snapshot_local", "park_id")])
    return summary.groupBy("file_date", "snapshot_local").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("park_id", counts)))).alias("parks"))


#: Records listed in a group of the report; the counts cover all.
LISTED = 1000


def _groups(rows: DataFrame, keys: list[str], record: list[Column]) -> DataFrame:
    """Groups of more than one row: their number, and the records in order.

    Sizes are counted first and only rows of such groups go on. A group of more than ``LISTED`` records has several rows: chunk 0
    with its first ``LISTED`` records by ``src_row``, chunk 1 with the next ones, and so on. Their numbers are worked out over
    range partitions, so no task holds a very large group whole.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")
    several = rows.join(sizes, keys).select(*keys, "row_count", "src_row", F.struct(*record).alias("r"))
    if sizes.where(F.col("row_count") > LISTED).isEmpty():
        return _listed(several.withColumn("chunk", F.lit(0).cast("long")), keys)
    large = Ordered(several.where(F.col("row_count") > LISTED), keys, ["src_row"]).ordinal("n").frame()
    large = large.withColumn("chunk", F.floor((F.col("n") - 1) / LISTED)).drop("n")
    all_ = several.where(F.col("row_count") <= LISTED).withColumn("chunk", F.lit(0).cast("long")).unionByName(large)
    return _listed(all_, keys)


def _listed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "row_count", "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("src_row", "r"))), lambda x: x["r"]).alias("records"))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Records of one snapshot and park with the same name."""
    return _groups(rows, ["file_date", "snapshot_ts", "park_id", "name"], [F.col(c) for c in ("ride_id", "ride_name", "is_open", "wait")])


def conflict_groups(rows: DataFrame) -> DataFrame:
    """Records of one snapshot and park that claim the same attraction and access mode."""
    age = times.age_tenths(F.col("age_ms")).alias("age_tenths")
    return _groups(rows, ["file_date", "snapshot_ts", "park_id", "canonical_id", "access_mode"], [*[F.col(c) for c in ("ride_id", "ride_name", "is_open", "wait")], age])


def stale_sources(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per park and ride name of the stale rows: their number and the highest age."""
    stale = rows.where(is_stale(settings))
    return stale.groupBy("file_date", "park_id", "ride_name").agg(F.count(F.lit(1)).alias("stale_rows"), F.max(times.age_tenths(F.col("age_ms"))).alias("max_age_tenths"))


def optimizer_summary(ready: DataFrame) -> DataFrame:
    use = lambda x: _count(F.col("training_eligibility") == x)
    return ready.groupBy("file_date").agg(
        F.count(F.lit(1)).alias("ready_rows"),
        _count(F.col("candidate_count") > 1).alias("conflict_resolved_rows"),
        use("standby_wait_model").alias("standby_wait_rows"),
        use("status_model_only").alias("status_only_rows"),
        use("single_rider_availability_only").alias("availability_only_rows"),
        use("single_rider_optimizer_reference").alias("wait_reference_rows"),
        _count(has_flag("stale_source")).alias("stale_selected_rows"),
    )


def single_rider_summary(profiles: DataFrame) -> DataFrame:
    use = lambda x: _count(F.col("optimizer_use") == x)
    return profiles.groupBy("file_date").agg(F.count(F.lit(1)).alias("groups"), use("use_wait_reference").alias("usable_groups"), use("availability_only").alias("availability_only_groups"))


def recommendations(cleaned: DataFrame, ready: DataFrame, singles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(file_date, recommendations): what applies, in order. Counts per date are joined, no groups are listed."""
    doubled = cleaned.groupBy("file_date", "snapshot_ts", "park_id", "name").count().where("count > 1").groupBy("file_date").agg(F.count(F.lit(1)).alias("duplicates"))
    stale = cleaned.groupBy("file_date").agg(_count(is_stale(settings)).alias("stale"))
    conflicts = ready.groupBy("file_date").agg(_count(F.col("candidate_count") > 1).alias("conflicts"))
    availability = singles.groupBy("file_date").agg(_count(F.col("optimizer_use") == "availability_only").alias("availability"))
    joined = stale.join(doubled, "file_date", "left").join(conflicts, "file_date", "left").join(availability, "file_date", "left")
    said = [F.when(F.coalesce(F.col(k) > 0, F.lit(False)) if k != "always" else F.lit(True), text) for k, text in ADVICE.items()]
    return joined.select("file_date", F.array_compact(F.array(*said)).alias("recommendations"))
