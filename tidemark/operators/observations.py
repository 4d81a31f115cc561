"""From observations to cleaned rows and to the one best row for each snapshot, attraction and access mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import names, times
from tidemark.operators.ordered import Ordered
from tidemark.workspace import Workspace

# The order in which a training use is preferred; what is stale comes after all others.
PRIORITY = {
    "standby_wait_model": 50,
    "single_rider_optimizer_reference": 45,
    "status_model_only": 40,
    "single_rider_availability_only": 35,
    "schedule_constraint_only": 20,
    "exclude_missing_wait": 10,
    "exclude_stale_source": 0,
}
STALE_PENALTY = 100
FLAGS = ["closed", "open_zero", "stale_source", "single_rider", "likely_entertainment", "possible_full_day_closed", "temporary_downtime", "single_rider_all_zero"]
WITH_WEIGHT = ["standby_wait_model", "single_rider_optimizer_reference"]


def named(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Everything that follows from a park and a ride's name, for each pair that ``rows`` has: comparable forms, what the name says, and the catalogue's match.

    ``aliases`` (park_id, alias, canonical_id, canonical_name, category) has one row for each park and alias; a match of
    the whole name goes before one of the base name.
    """
    name = F.col("ride_name")
    told = rows.select("park_id", "ride_name").distinct().withColumns(
        {"is_single_rider": names.is_single_rider(name), "is_entertainment": names.is_entertainment(name), "base_ride_name": names.base_name(name), "name": names.catalog_name(name)}
    )
    told = told.withColumn("base", names.catalog_name(F.col("base_ride_name")))
    told = told.withColumn("own_name", F.coalesce(F.nullif("base", F.lit("")), F.nullif("name", F.lit("")))).withColumn("own_slug", F.when(F.col("own_name").isNotNull(), names.slug(F.col("own_name"))))
    found = "struct<canonical_id: string, canonical_name: string, category: string>"
    if aliases is None:
        return told.withColumns({"_exact": F.lit(None).cast(found), "_base": F.lit(None).cast(found)})
    match = F.struct("canonical_id", "canonical_name", "category")
    for key, as_ in (("name", "_exact"), ("base", "_base")):
        told = told.join(aliases.select("park_id", F.col("alias").alias(key), match.alias(as_)), ["park_id", key], "left")
    return told


def normalize(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Names in comparable form, the age of the source, and the canonical attraction.

    Names repeat in each snapshot, so they are worked out once for each park and name (see ``named``) and written; whether that
    table is broadcast is left to its true size. Without a match in the catalogue the base name itself makes the identity.
    """
    told = Workspace(rows.sparkSession, "names").table(named(rows, aliases), "names")
    told = told.withColumnsRenamed({"park_id": "_park_id", "ride_name": "_ride_name"})
    same = F.col("park_id").eqNullSafe(F.col("_park_id")) & F.col("ride_name").eqNullSafe(F.col("_ride_name"))
    rows = rows.join(told, same, "left").drop("_park_id", "_ride_name")
    # A row whose name has no letter or digit is known by its id.
    known = F.coalesce("own_name", "ride_id", F.lit("unknown"))
    own = {
        "canonical_id": F.concat("park_id", F.lit("-"), F.coalesce("own_slug", names.slug(known))),
        "canonical_name": F.coalesce(F.nullif("base_ride_name", F.lit("")), F.nullif("ride_name", F.lit("")), known),
        "category": F.when(F.col("is_entertainment"), "entertainment").otherwise("attraction"),
    }
    best = F.coalesce("_exact", "_base")
    said = F.when(F.col("_exact").isNotNull(), "alias_exact").when(F.col("_base").isNotNull(), "alias_base").otherwise("auto_normalized")
    made = {c: F.when(best.isNotNull(), best[c]).otherwise(v) for c, v in own.items()} | {"match_source": said}
    made |= {"access_mode": F.when(F.col("is_single_rider"), "single_rider").otherwise("standby"), "age_ms": times.age_millis(F.col("snapshot_ts"), F.col("source_ts"))}
    return rows.withColumns(made).drop("_exact", "_base", "own_name", "own_slug")


RIDE_KEY = ["file_date", "park_id", "ride_key"]


def with_ride_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ride_key", F.coalesce(F.nullif("ride_id", F.lit("")), "name"))


def ride_profiles(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per file date, park and ride: rows, open and closed ones, changes of status in order of time, and what follows.

    A row's status is compared with the one before it over range partitions, so a ride with most of all rows is no task's.
    """
    placed = Ordered(with_ride_key(rows).select(*RIDE_KEY, "snapshot_ts", "src_row", "is_open", "ride_id", "ride_name", "name"), RIDE_KEY, ["snapshot_ts", "src_row"])
    changed = placed.previous("before", F.col("is_open")).frame().withColumn("changed", F.coalesce(F.col("is_open") != F.col("before"), F.lit(False)).cast("long"))
    first = F.min_by(F.struct("ride_id", "ride_name", "name"), F.struct("snapshot_ts", "src_row")).alias("first")
    made = changed.groupBy(*RIDE_KEY).agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("is_open").alias("open_rows"), F.sum("changed").alias("transitions"), first)
    closed = F.col("total_rows") - F.col("open_rows")
    return made.select(
        *RIDE_KEY, "first.ride_id", "first.ride_name", "first.name", "total_rows", "open_rows", closed.alias("closed_rows"),
        (F.floor(closed / F.col("total_rows") * 1000 + 0.5) / 1000).alias("closed_ratio"), "transitions",
        (closed / F.col("total_rows") >= settings.full_day_closed_ratio).alias("possible_full_day_closed"),
        ((F.col("open_rows") > 0) & (closed > 0) & (F.col("transitions") >= 2)).alias("temporary_downtime"),
    )


def single_rider_profiles(rows: DataFrame) -> DataFrame:
    """Per file date, park and base name of the single-rider rows: counts of their waits, and what they are good for."""
    own = rows.where("is_single_rider")
    made = own.groupBy("file_date", "park_id", "base").agg(
        F.min_by("base_ride_name", "src_row").alias("base_ride_name"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("is_open").alias("open_rows"),
        F.count_if(~F.col("is_open")).alias("closed_rows"),
        F.count_if(F.coalesce(F.col("wait") == 0, F.lit(False))).alias("zero_wait_rows"),
        F.count_if(F.coalesce(F.col("is_open") & (F.col("wait") > 0), F.lit(False))).alias("positive_wait_rows"),
        F.count("wait").alias("_waits"),
    )
    use = F.when(F.col("positive_wait_rows") > 0, "use_wait_reference").otherwise("availability_only")
    return made.withColumns({"all_observed_waits_zero": (F.col("_waits") > 0) & (F.col("positive_wait_rows") == 0), "optimizer_use": use}).drop("_waits")


def is_stale(settings: Settings) -> Column:
    return F.coalesce(F.col("age_ms") > settings.stale_minutes * 60_000, F.lit(False))


def clean(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row, with quality_flags, observed_wait and training_eligibility. Nothing is dropped.

    Both profiles are aggregates with a row per ride and day, so they combine before the shuffle and are joined
    back; only the changes of status need the rows of a ride in order (see ``ride_profiles``).
    """
    rows = with_ride_key(rows)
    rides = ride_profiles(rows, settings).select(*RIDE_KEY, "possible_full_day_closed", "temporary_downtime")
    singles = single_rider_profiles(rows).select("file_date", "park_id", "base", "all_observed_waits_zero")
    out = rows.join(rides, RIDE_KEY, "left").join(singles, ["file_date", "park_id", "base"], "left")
    zero = F.coalesce(F.col("all_observed_waits_zero"), F.lit(False))
    says = [
        ~F.col("is_open"),
        F.col("is_open") & (F.col("wait") == 0),
        is_stale(settings),
        F.col("is_single_rider"),
        F.col("is_entertainment"),
        F.col("possible_full_day_closed"),
        F.col("temporary_downtime"),
        F.col("is_single_rider") & zero,
    ]
    single = F.when(~zero, "single_rider_optimizer_reference").otherwise("single_rider_availability_only")
    use = (
        F.when(is_stale(settings), "exclude_stale_source")
        .when(F.col("is_entertainment"), "schedule_constraint_only")
        .when(F.col("is_single_rider"), single)
        .when(~F.col("is_open"), "status_model_only")
        .when(F.col("wait").isNull(), "exclude_missing_wait")
        .otherwise("standby_wait_model")
    )
    made = {
        "quality_flags": F.array_compact(F.array(*[F.when(x, flag) for flag, x in zip(FLAGS, says)])),
        "observed_wait": F.when(F.col("is_open"), F.col("wait")),
        "training_eligibility": use,
        "age_tenths": times.age_tenths(F.col("age_ms")),
    }
    return out.withColumns(made).drop("possible_full_day_closed", "temporary_downtime", "all_observed_waits_zero")


CANDIDATE_KEY = ["snapshot_ts", "park_id", "canonical_id", "access_mode"]


def has_flag(flag: str) -> Column:
    return F.array_contains("quality_flags", flag)


def resolve(cleaned: DataFrame) -> DataFrame:
    """The best row of each snapshot, park, attraction and access mode, with its number of candidates and the reason.

    Preferred are the better training use, the younger source (an unknown age counts as 0), the later source instant,
    the smaller ride id, the earlier row. It is a minimum over a struct of these, which combines before the shuffle, so a
    key with very many candidates is no task's burden.
    """
    level = F.coalesce(*[F.when(F.col("training_eligibility") == k, v) for k, v in PRIORITY.items()], F.lit(0)) - F.when(has_flag("stale_source"), STALE_PENALTY).otherwise(0)
    order = [(-level).alias("_1"), F.coalesce("age_tenths", F.lit(0)).alias("_2"), (-F.coalesce(F.unix_micros("source_ts"), F.lit(0))).alias("_3"), F.col("ride_id"), F.col("src_row")]
    kept = ["file_date", "ride_name", "canonical_name", "category", "match_source", "is_open", "wait", "observed_wait", "source_ts", "age_tenths", "quality_flags", "training_eligibility"]
    groups = cleaned.groupBy(*CANDIDATE_KEY).agg(
        F.min(F.struct(*order, *kept)).alias("best"), F.count(F.lit(1)).alias("candidate_count"), F.count_if(~has_flag("stale_source")).alias("non_stale_count")
    )
    reason = (
        F.when(F.col("candidate_count") == 1, "single_candidate")
        .when((F.col("non_stale_count") > 0) & F.array_contains("best.quality_flags", "stale_source"), "fallback_to_stale_only")
        .when(F.col("non_stale_count") > 0, "selected_best_non_stale_candidate")
        .otherwise("selected_best_available_candidate")
    )
    out = groups.select(*CANDIDATE_KEY, "best.ride_id", "best.src_row", *[f"best.{c}" for c in kept], "candidate_count", "non_stale_count", reason.alias("resolver_reason"))
    return out.withColumn("wait_weight", F.when(F.col("training_eligibility").isin(WITH_WEIGHT), F.col("observed_wait")))
