"""The engine's operators over the given tables, one query each, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import names, numbers, times
from tidemark.operators import items, lineage, observations, quality, windows
from tidemark.plans.analyze import analyze
from tidemark.sources.events import event_observations

#: Ages of event observations are spread over six hours; half of them count as stale.
SETTINGS = Settings(stale_minutes=180, zone="UTC")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


ALIASES = [("p0", "Coaster & Loop 1", "p0-loop", "The Loop", "attraction"), ("p1", "coaster and loop 1 single rider", "p1-solo", "Solo", "attraction"), ("p1", "Coaster & Loop 2", "p1-two", "Two", "attraction")]


def alias_table(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ALIASES, "park_id string, alias_name string, canonical_id string, canonical_name string, category string")
    return rows.select("park_id", names.catalog_name(F.col("alias_name")).alias("alias"), "canonical_id", "canonical_name", "category")


def schedule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of p0 alone: from 06:00 to 17:00, on days whose number isn't divisible by five."""
    days = event_observations(spark, sf_dir).select("file_date").distinct().where("day(to_date(file_date)) % 5 <> 0")
    hour = lambda h: F.timestamp_add("HOUR", F.lit(h), F.to_timestamp("file_date"))
    return days.select(F.lit("p0").alias("park_id"), F.lit(0).alias("position"), F.col("file_date").alias("date"), hour(6).alias("opens"), hour(17).alias("closes"))


def analysis(spark: SparkSession, sf_dir: str):
    return analyze(event_observations(spark, sf_dir), alias_table(spark), schedule_table(spark, sf_dir), SETTINGS)


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.normalize(event_observations(spark, sf_dir), alias_table(spark))


# The same in SQL: observations of the events, normalised, profiled, cleaned, resolved.
_OBS = """
obs0 AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 21600000000 * 21600000000 AS b, user_id, event_type, value FROM events),
obs AS (SELECT event_id AS src_row, CAST(CAST(make_timestamp(b) AS DATE) AS VARCHAR) AS file_date, make_timestamp(b + 21600000000) AS snapshot_ts, make_timestamp(us) AS source_ts,
    'p' || user_id % 2 AS park_id, CAST(user_id % 10 AS VARCHAR) AS ride_id,
    'Coaster & Loop ' || user_id % 5 || CASE event_type WHEN 'signup' THEN ' Single Rider' WHEN 'purchase' THEN ' Parade' ELSE '' END AS ride_name,
    NOT (event_type = 'error' OR user_id % 10 = 3 AND date_diff('day', DATE '2024-01-01', CAST(make_timestamp(b) AS DATE)) % 3 = 0) AS is_open,
    CASE WHEN user_id % 10 = 4 OR value < 2 THEN 0.0 ELSE floor(value) END AS wait, (b + 21600000000) // 1000 - us // 1000 AS age_ms FROM obs0),
norm0 AS (SELECT *, contains(ride_name, 'Single Rider') AS is_single_rider, contains(ride_name, 'Parade') AS is_entertainment, replace(ride_name, ' Single Rider', '') AS base_ride_name,
    replace(lower(ride_name), '&', 'and') AS name, replace(lower(replace(ride_name, ' Single Rider', '')), '&', 'and') AS base, CASE WHEN contains(ride_name, 'Single Rider') THEN 'single_rider' ELSE 'standby' END AS access_mode FROM obs),
alias(park_id, alias, canonical_id, canonical_name, category) AS (VALUES ('p0', 'coaster and loop 1', 'p0-loop', 'The Loop', 'attraction'), ('p1', 'coaster and loop 1 single rider', 'p1-solo', 'Solo', 'attraction'), ('p1', 'coaster and loop 2', 'p1-two', 'Two', 'attraction')),
norm AS (SELECT n.*, coalesce(x.canonical_id, y.canonical_id, n.park_id || '-' || replace(n.base, ' ', '-')) AS canonical_id, coalesce(x.canonical_name, y.canonical_name, n.base_ride_name) AS canonical_name,
    coalesce(x.category, y.category, CASE WHEN is_entertainment THEN 'entertainment' ELSE 'attraction' END) AS category,
    CASE WHEN x.alias IS NOT NULL THEN 'alias_exact' WHEN y.alias IS NOT NULL THEN 'alias_base' ELSE 'auto_normalized' END AS match_source
    FROM norm0 n LEFT JOIN alias x ON x.park_id = n.park_id AND x.alias = n.name LEFT JOIN alias y ON y.park_id = n.park_id AND y.alias = n.base),
turns AS (SELECT *, is_open <> lag(is_open) OVER (PARTITION BY file_date, park_id, ride_id ORDER BY snapshot_ts, src_row) AS changed FROM norm),
rides AS (SELECT file_date, park_id, ride_id AS ride_key, count(*) AS total_rows, count(*) FILTER (is_open) AS open_rows, count(*) FILTER (NOT is_open) AS closed_rows, count(*) FILTER (changed) AS transitions,
    count(*) FILTER (NOT is_open) >= 0.9 * count(*) AS possible_full_day_closed, count(*) FILTER (changed) >= 2 AND bool_or(is_open) AND NOT bool_and(is_open) AS temporary_downtime FROM turns GROUP BY ALL),
singles AS (SELECT file_date, park_id, base, count(*) AS total_rows, count(*) FILTER (is_open) AS open_rows, count(*) FILTER (NOT is_open) AS closed_rows, count(*) FILTER (wait = 0) AS zero_wait_rows,
    count(*) FILTER (is_open AND wait > 0) AS positive_wait_rows, count(wait) > 0 AND count(*) FILTER (is_open AND wait > 0) = 0 AS all_observed_waits_zero,
    CASE WHEN count(*) FILTER (is_open AND wait > 0) > 0 THEN 'use_wait_reference' ELSE 'availability_only' END AS optimizer_use FROM norm WHERE is_single_rider GROUP BY ALL),
cleaned AS (SELECT n.*, n.ride_id AS ride_key, age_ms > 10800000 AS stale, possible_full_day_closed, temporary_downtime, coalesce(all_observed_waits_zero, false) AS zero,
    concat_ws('|', CASE WHEN NOT is_open THEN 'closed' END, CASE WHEN is_open AND wait = 0 THEN 'open_zero' END, CASE WHEN age_ms > 10800000 THEN 'stale_source' END, CASE WHEN is_single_rider THEN 'single_rider' END,
        CASE WHEN is_entertainment THEN 'likely_entertainment' END, CASE WHEN possible_full_day_closed THEN 'possible_full_day_closed' END, CASE WHEN temporary_downtime THEN 'temporary_downtime' END,
        CASE WHEN is_single_rider AND all_observed_waits_zero THEN 'single_rider_all_zero' END) AS flags,
    CASE WHEN is_open THEN wait END AS observed_wait, CAST(floor((age_ms + 3000) / 6000) AS BIGINT) AS age_tenths,
    CASE WHEN age_ms > 10800000 THEN 'exclude_stale_source' WHEN is_entertainment THEN 'schedule_constraint_only'
        WHEN is_single_rider THEN CASE WHEN all_observed_waits_zero THEN 'single_rider_availability_only' ELSE 'single_rider_optimizer_reference' END
        WHEN NOT is_open THEN 'status_model_only' WHEN wait IS NULL THEN 'exclude_missing_wait' ELSE 'standby_wait_model' END AS training_eligibility
    FROM norm n JOIN rides r ON r.file_date = n.file_date AND r.park_id = n.park_id AND r.ride_key = n.ride_id LEFT JOIN singles s ON s.file_date = n.file_date AND s.park_id = n.park_id AND s.base = n.base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY snapshot_ts, park_id, canonical_id, access_mode ORDER BY
        CASE training_eligibility WHEN 'standby_wait_model' THEN 50 WHEN 'single_rider_optimizer_reference' THEN 45 WHEN 'status_model_only' THEN 40 WHEN 'single_rider_availability_only' THEN 35
            WHEN 'schedule_constraint_only' THEN 20 WHEN 'exclude_missing_wait' THEN 10 ELSE 0 END - CASE WHEN stale THEN 100 ELSE 0 END DESC, age_tenths, source_ts DESC, ride_id, src_row) AS nth,
    count(*) OVER w AS candidate_count, count(*) FILTER (NOT stale) OVER w AS non_stale_count FROM cleaned WINDOW w AS (PARTITION BY snapshot_ts, park_id, canonical_id, access_mode)),
ready AS (SELECT *, CASE WHEN candidate_count = 1 THEN 'single_candidate' WHEN non_stale_count > 0 AND stale THEN 'fallback_to_stale_only' WHEN non_stale_count > 0 THEN 'selected_best_non_stale_candidate' ELSE 'selected_best_available_candidate' END AS resolver_reason,
    CASE WHEN training_eligibility IN ('standby_wait_model', 'single_rider_optimizer_reference') THEN observed_wait END AS wait_weight FROM ranked WHERE nth = 1)"""


def obs_sql(select: str) -> str:
    return f"WITH {_OBS}\n{select}"


@query(obs_sql("SELECT src_row, snapshot_ts, park_id, ride_name, base_ride_name, name, base, access_mode, is_entertainment, canonical_id, canonical_name, category, match_source, age_ms FROM norm"))
def alias_resolution(spark, sf_dir):
    return normal(spark, sf_dir).select("src_row", "snapshot_ts", "park_id", "ride_name", "base_ride_name", "name", "base", "access_mode", "is_entertainment", "canonical_id", "canonical_name", "category", "match_source", "age_ms")


@query(obs_sql("SELECT src_row, file_date, park_id, ride_id, is_open, wait, observed_wait, age_tenths, flags AS quality_flags, training_eligibility FROM cleaned"))
def clean_observations(spark, sf_dir):
    rows = analysis(spark, sf_dir).cleaned
    return rows.select("src_row", "file_date", "park_id", "ride_id", "is_open", "wait", "observed_wait", "age_tenths", F.concat_ws("|", "quality_flags").alias("quality_flags"), "training_eligibility")


@query(obs_sql("SELECT snapshot_ts, park_id, canonical_id, access_mode, ride_id, src_row, canonical_name, wait_weight, flags AS quality_flags, training_eligibility, candidate_count, non_stale_count, resolver_reason FROM ready"))
def optimizer_ready(spark, sf_dir):
    rows = analysis(spark, sf_dir).ready
    return rows.select("snapshot_ts", "park_id", "canonical_id", "access_mode", "ride_id", "src_row", "canonical_name", "wait_weight", F.concat_ws("|", "quality_flags").alias("quality_flags"), "training_eligibility", "candidate_count", "non_stale_count", "resolver_reason")


@query(obs_sql("SELECT *, floor(closed_rows / total_rows * 1000 + 0.5) / 1000 AS closed_ratio FROM rides"))
def ride_profiles(spark, sf_dir):
    return analysis(spark, sf_dir).rides.drop("ride_id", "ride_name", "name")


@query(obs_sql("SELECT * FROM singles"))
def single_rider_profiles(spark, sf_dir):
    return analysis(spark, sf_dir).singles.drop("base_ride_name")


_STATES = "count(*) AS total_rows, count(*) FILTER (NOT is_open) AS closed_rows, count(*) FILTER (wait = 0) AS zero_wait_rows, count(*) FILTER (is_open AND wait = 0) AS open_zero_rows"


@query(obs_sql(f"""SELECT file_date, {_STATES}, count(DISTINCT snapshot_ts) AS snapshots, count(DISTINCT park_id || '|' || ride_id) AS rides, count(DISTINCT canonical_id) AS canonical_attractions, count(*) FILTER (stale) AS stale_rows,
    count(*) FILTER (is_single_rider) AS single_rider_rows, count(*) FILTER (is_entertainment) AS entertainment_rows, count(*) FILTER (training_eligibility = 'standby_wait_model') AS standby_model_rows,
    count(*) FILTER (training_eligibility = 'status_model_only') AS status_only_rows FROM cleaned GROUP BY file_date"""))  # fmt: skip
def quality_summary(spark, sf_dir):
    return quality.summary(analysis(spark, sf_dir).cleaned, SETTINGS)


@query(obs_sql(f"SELECT file_date, park_id, {_STATES}, count(DISTINCT snapshot_ts) AS snapshots, count(*) FILTER (stale) AS stale_rows FROM cleaned GROUP BY ALL"))
def park_summary(spark, sf_dir):
    return quality.park_summary(analysis(spark, sf_dir).cleaned, SETTINGS)


@query(obs_sql(f"SELECT file_date, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_local, park_id, {_STATES} FROM cleaned GROUP BY ALL"))
def snapshot_park_summary(spark, sf_dir):
    return quality.snapshot_park_summary(normal(spark, sf_dir), SETTINGS)


def _record(*columns: str):
    return lambda x: F.concat_ws("/", *[x[c].cast("string") for c in columns])


_GROUP_SQL = "string_agg(concat_ws('/', ride_id, ride_name, CASE WHEN is_open THEN 'true' ELSE 'false' END, CAST(CAST(wait AS INT) AS VARCHAR)), ';' ORDER BY src_row) AS records"


def _group_sql(keys: str) -> str:
    """Groups of more than one row, in chunks of a thousand records."""
    k = f"file_date, snapshot_ts, park_id, {keys}"
    return f"SELECT {k}, row_count, chunk, {_GROUP_SQL} FROM (SELECT *, count(*) OVER (PARTITION BY {k}) AS row_count, (row_number() OVER (PARTITION BY {k} ORDER BY src_row) - 1) // {quality.LISTED} AS chunk FROM norm) WHERE row_count > 1 GROUP BY ALL"


def _groups_flat(groups: DataFrame) -> DataFrame:
    said = F.transform("records", lambda x: F.concat_ws("/", x["ride_id"], x["ride_name"], x["is_open"].cast("string"), x["wait"].cast("int").cast("string")))
    return groups.withColumn("records", F.array_join(said, ";"))


@query(obs_sql(_group_sql("name")))
def duplicate_groups(spark, sf_dir):
    return _groups_flat(quality.duplicate_groups(normal(spark, sf_dir)))


@query(obs_sql(_group_sql("canonical_id, access_mode")))
def conflict_groups(spark, sf_dir):
    return _groups_flat(quality.conflict_groups(normal(spark, sf_dir)))


@query(obs_sql("SELECT file_date, park_id, ride_name, count(*) AS stale_rows, max(age_tenths) AS max_age_tenths FROM cleaned WHERE stale GROUP BY ALL"))
def stale_sources(spark, sf_dir):
    return quality.stale_sources(normal(spark, sf_dir), SETTINGS)


@query(obs_sql("""SELECT file_date, count(*) AS ready_rows, count(*) FILTER (candidate_count > 1) AS conflict_resolved_rows, count(*) FILTER (training_eligibility = 'standby_wait_model') AS standby_wait_rows,
    count(*) FILTER (training_eligibility = 'status_model_only') AS status_only_rows, count(*) FILTER (training_eligibility = 'single_rider_availability_only') AS availability_only_rows,
    count(*) FILTER (training_eligibility = 'single_rider_optimizer_reference') AS wait_reference_rows, count(*) FILTER (stale) AS stale_selected_rows FROM ready GROUP BY file_date"""))  # fmt: skip
def optimizer_summary(spark, sf_dir):
    return quality.optimizer_summary(analysis(spark, sf_dir).ready)


@query(obs_sql("SELECT training_eligibility, park_id, count(*) AS n FROM cleaned GROUP BY ALL"))
def eligibility_counts(spark, sf_dir):
    return analysis(spark, sf_dir).cleaned.groupBy("training_eligibility", "park_id").agg(F.count(F.lit(1)).alias("n"))


@query(obs_sql("""SELECT file_date, count(*) AS groups, count(*) FILTER (optimizer_use = 'use_wait_reference') AS usable_groups, count(*) FILTER (optimizer_use = 'availability_only') AS availability_only_groups FROM singles GROUP BY file_date"""))
def single_rider_summary(spark, sf_dir):
    return quality.single_rider_summary(analysis(spark, sf_dir).singles)


@query(obs_sql("""SELECT s.file_date, s.snapshot_ts, p.park_id, CASE WHEN h.file_date IS NULL THEN true ELSE s.snapshot_ts BETWEEN opens - INTERVAL 30 MINUTE AND closes + INTERVAL 60 MINUTE END AS expected, t.park_id IS NOT NULL AS rows_present,
    CASE WHEN expected AND NOT rows_present THEN 'missing' WHEN NOT expected AND rows_present THEN 'unexpected' ELSE 'as_expected' END AS state
    FROM (SELECT DISTINCT file_date, snapshot_ts FROM norm) s CROSS JOIN (SELECT DISTINCT park_id FROM norm) p
    LEFT JOIN (SELECT DISTINCT file_date, 'p0' AS park_id, CAST(file_date AS TIMESTAMP) + INTERVAL 6 HOUR AS opens, CAST(file_date AS TIMESTAMP) + INTERVAL 17 HOUR AS closes FROM norm WHERE day(CAST(file_date AS DATE)) % 5 <> 0) h ON h.park_id = p.park_id AND h.file_date = s.file_date
    LEFT JOIN (SELECT DISTINCT file_date, snapshot_ts, park_id FROM norm) t ON t.file_date = s.file_date AND t.snapshot_ts = s.snapshot_ts AND t.park_id = p.park_id"""))  # fmt: skip
def collection_window_gaps(spark, sf_dir):
    return analysis(spark, sf_dir).gaps.drop("opens", "closes")


@query(obs_sql("""SELECT o.src_row, w.file_date IS NOT NULL AS should_collect, coalesce(w.opens, n.opens) AS opens FROM (SELECT src_row, source_ts, park_id FROM norm) o
    LEFT JOIN (SELECT DISTINCT file_date, CAST(file_date AS TIMESTAMP) + INTERVAL 6 HOUR AS opens, CAST(file_date AS TIMESTAMP) + INTERVAL 17 HOUR AS closes FROM norm WHERE day(CAST(file_date AS DATE)) % 5 <> 0) w
        ON o.park_id = 'p0' AND o.source_ts BETWEEN w.opens - INTERVAL 30 MINUTE AND w.closes + INTERVAL 60 MINUTE
    LEFT JOIN LATERAL (SELECT arg_min(opens, (abs(epoch_us(opens) - epoch_us(o.source_ts)), opens)) AS opens FROM (SELECT DISTINCT CAST(file_date AS TIMESTAMP) + INTERVAL 6 HOUR AS opens FROM norm WHERE day(CAST(file_date AS DATE)) % 5 <> 0)) n ON w.file_date IS NULL AND o.park_id = 'p0'"""))  # fmt: skip
def nearest_window(spark, sf_dir):
    asked = event_observations(spark, sf_dir).select("src_row", "park_id", F.col("source_ts").alias("at"))
    return windows.collecting(asked, schedule_table(spark, sf_dir), SETTINGS).select("src_row", "should_collect", "opens")


@query(obs_sql("SELECT max(snapshot_ts) AS latest, TIMESTAMP '2024-01-08 00:03:00' - max(snapshot_ts) < INTERVAL 5 MINUTE AS skip FROM obs"))
def throttle(spark, sf_dir):
    return windows.throttled(event_observations(spark, sf_dir), F.lit("2024-01-08 00:03:00").cast("timestamp"), SETTINGS)


@query("""SELECT event_id, strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS local_text, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS local_date,
    hour(ts) * 60 + minute(ts) AS minute_of_day, CASE WHEN value >= 60 THEN 'high' WHEN value >= 30 THEN 'medium' WHEN value IS NULL THEN 'unknown' ELSE 'low' END AS intensity, floor(value * 10 + 0.5) / 10 AS rounded,
    greatest(3.0, least(97.0, value)) AS clamped FROM events""")  # fmt: skip
def local_time_render(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    zone = "America/Los_Angeles"
    return events.select("event_id", times.local_text(F.col("at"), zone).alias("local_text"), times.local_date(F.col("at"), zone).alias("local_date"), times.minute_of(F.date_format("at", "HH:mm")).alias("minute_of_day"),
        numbers.intensity(F.col("value")).alias("intensity"), numbers.half_up(F.col("value"), 1).alias("rounded"), numbers.clamp(F.col("value"), 3.0, 97.0).alias("clamped"))


@query("""WITH t AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events) SELECT event_id, strftime(ts, '%H:%M') AS clock,
    (CASE WHEN m < 540 THEN m + 1440 ELSE m END BETWEEN 510 AND 1485) OR (CASE WHEN m < 1200 THEN m + 1440 ELSE m END BETWEEN 1170 AND 1605) AS inside FROM t JOIN events USING (event_id)""")
def clock_windows(spark, sf_dir):
    clock = F.date_format(F.col("ts").cast("timestamp"), "HH:mm")
    hours = F.array(F.lit("09:00 - 00:00"), F.lit("20:00 - 02:00"))
    return read(spark, sf_dir, "events").select("event_id", clock.alias("clock"), times.within_hours(clock, hours).alias("inside"))


@query("""SELECT doc_id, left(trim(regexp_replace(lower(coalesce(source, 'unknown')), '[^a-z0-9]+', '-', 'g'), '-'), 80) AS slug, doc_id AS id FROM documents""")
def slugs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", names.slug(F.col("source")).alias("slug"), F.col("doc_id").alias("id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_CATALOG = "SELECT p_partkey AS id, p_brand || ' ' || p_partkey % 400 AS name, p_type AS kind, CASE WHEN p_size < 10 THEN 'Uncategorized' ELSE p_brand END AS land, p_size AS wait, p_size > 5 AS is_open FROM part"


def item_table(spark, sf_dir):
    """Parts as catalogue items."""
    size, brand = F.col("p_size"), F.col("p_brand")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", brand, F.col("p_partkey") % 400).alias("name"), F.col("p_type").alias("kind"),
        F.when(size < 10, "Uncategorized").otherwise(brand).alias("land"), size.alias("wait"), (size > 5).alias("is_open"), F.when(size > 5, "OPEN").otherwise("CLOSED").alias("status"), F.lit("catalog").alias("source"))


@query(f"""WITH c AS ({_CATALOG}), q AS (SELECT s_suppkey AS id, 'BRAND#' || s_nationkey || ' ' || s_suppkey % 60 AS name, 'Land ' || s_nationkey AS land, CAST(floor(s_acctbal / 100) AS INT) AS wait, s_acctbal > 0 AS is_open FROM supplier),
    l AS (SELECT lower(name) AS k, arg_max(land, id) AS land, arg_max(wait, id) AS wait, arg_max(is_open, id) AS is_open FROM q GROUP BY 1)
    SELECT c.id, c.name, CASE WHEN l.k IS NOT NULL AND c.land = 'Uncategorized' THEN l.land ELSE c.land END AS land, CASE WHEN l.k IS NOT NULL THEN l.wait ELSE c.wait END AS wait, CASE WHEN l.k IS NOT NULL THEN l.is_open ELSE c.is_open END AS is_open,
        CASE WHEN l.k IS NOT NULL THEN 'catalog + queue feed' ELSE 'catalog' END AS source FROM c LEFT JOIN l ON lower(c.name) = l.k
    UNION ALL SELECT id, name, land, wait, is_open, 'queue' FROM q WHERE lower(name) NOT IN (SELECT lower(name) FROM c)""")  # fmt: skip
def feed_merge(spark, sf_dir):
    queue = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("position"), F.concat(F.lit("BRAND#"), F.col("s_nationkey"), F.lit(" "), F.col("s_suppkey") % 60).alias("name"),
        F.concat(F.lit("Land "), F.col("s_nationkey")).alias("land"), F.floor(F.col("s_acctbal") / 100).cast("int").alias("wait"), (F.col("s_acctbal") > 0).alias("is_open"), F.lit("OPEN").alias("status"), F.lit("queue").alias("source"))
    return items.merge_feeds(item_table(spark, sf_dir), queue).drop("status")


@query("""SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, 'CUSTOMER#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') FROM supplier
    WHERE lower('CUSTOMER#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0')) NOT IN (SELECT lower(c_name) FROM customer)""")
def missing_items(spark, sf_dir):
    ours = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    more = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("CUSTOMER#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0")).alias("name"))
    return items.add_missing(ours, more)


@query("""WITH b AS (SELECT p_partkey AS id, 'Ride ' || p_partkey % 97 || CASE WHEN p_partkey % 3 = 0 THEN ' Single Rider' ELSE '' END AS name, p_partkey % 97 AS k, p_partkey % 3 = 0 AS s, p_size AS wait FROM part),
    l AS (SELECT k, arg_max(wait, id) AS wait FROM b WHERE s GROUP BY k) SELECT b.id, b.name, b.wait, l.k IS NOT NULL AS has_single_rider, l.wait AS single_rider_wait FROM b LEFT JOIN l USING (k) WHERE NOT b.s""")
def self_attach(spark, sf_dir):
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(key.alias("id"), F.concat(F.lit("Ride "), key % 97, F.when(key % 3 == 0, " Single Rider").otherwise("")).alias("name"), F.col("p_size").alias("wait"), F.lit("OPEN").alias("status"), key.alias("position"))
    found = items.attach_single_rider(rows.withColumn("is_single_rider", names.is_single_rider(F.col("name"))))
    return found.select("id", "name", "wait", "has_single_rider", "single_rider_wait")


@query(f"SELECT id, name, wait FROM ({_CATALOG}) WHERE is_open AND contains(lower(name), 'brand#1') ORDER BY wait DESC, name, id LIMIT 100")
def item_view_top(spark, sf_dir):
    rows = item_table(spark, sf_dir).withColumns({"park_id": F.lit("p"), "category": F.lit("attraction")})
    return items.in_order(items.view(rows, status="open", search=" Brand#1")).limit(100).select("id", "name", "wait")


@query(f"SELECT land, count(*) FILTER (is_open) AS open_count, CAST(coalesce(floor(avg(wait) FILTER (is_open) + 0.5), 0) AS BIGINT) AS average_wait, coalesce(CAST(max(wait) FILTER (is_open) AS VARCHAR), 'N/A') AS max_wait FROM ({_CATALOG}) GROUP BY land")
def kpi_summary(spark, sf_dir):
    return items.kpis(item_table(spark, sf_dir).withColumn("category", F.lit("attraction")), ["land"])


@query("""WITH b AS (SELECT c_nationkey AS g, max(c_acctbal) AS n, min(c_acctbal) AS s, min(CAST(c_custkey AS DOUBLE)) AS w, max(CAST(c_custkey AS DOUBLE)) AS e FROM customer GROUP BY 1)
    SELECT g, n + greatest((n - s) * 0.08, 0.0008) AS north, s - greatest((n - s) * 0.08, 0.0008) AS south, w - greatest((e - w) * 0.08, 0.0008) AS west, e + greatest((e - w) * 0.08, 0.0008) AS east FROM b""")
def map_bounds(spark, sf_dir):
    return items.bounds(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("lat"), F.col("c_custkey").cast("double").alias("lon")), ["g"])


@query("""SELECT n_nationkey, 34.0 - (34.0 - 33.0) * (((n_nationkey * 2 + n_regionkey) % 5 + 0.5) / 5) AS lat, -118.0 + (-117.0 - -118.0) * (((n_nationkey + n_regionkey) % 5 + 0.5) / 5) AS lon FROM nation""".replace("34.0 - (34.0 - 33.0)", "34::DOUBLE - (34::DOUBLE - 33::DOUBLE)").replace("-118.0 + (-117.0 - -118.0)", "-118::DOUBLE + (-117::DOUBLE - -118::DOUBLE)").replace("+ 0.5) / 5", "+ 0.5::DOUBLE) / 5"))
def grid_estimate(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", *items.estimated(F.lit(34.0), F.lit(33.0), F.lit(-118.0), F.lit(-117.0), F.col("n_nationkey"), F.col("n_regionkey")))


@query("SELECT o_orderkey, sha256(o_orderkey || ':' || o_orderstatus || ':' || o_orderpriority) AS content_id FROM orders")
def content_ids(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", lineage.content_id(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("content_id"))


_LINE = ["l_orderkey", "l_linenumber"]
_LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE_ORDER)}) AS ordinal FROM lineitem),
    c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE_ORDER)}) AS ordinal FROM lineitem WHERE l_returnflag <> 'N')
    SELECT c.l_orderkey, c.l_linenumber, ordinal, c.l_extendedprice, sha256(r.l_orderkey || ':' || r.l_linenumber || ':' || r.l_partkey || ':' || r.l_suppkey) AS raw_observation_id FROM c LEFT JOIN r USING (l_orderkey, l_linenumber, ordinal)""")
def lineage_match(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(*_LINE, *_LINE_ORDER)
    raw_id = lineage.content_id(*[F.col(c).cast("string") for c in [*_LINE, "l_partkey", "l_suppkey"]])
    return lineage.matched(lines.where("l_returnflag <> 'N'"), lines, _LINE, _LINE_ORDER, raw_id).select(*_LINE, "ordinal", "l_extendedprice", "raw_observation_id")


@query("SELECT DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS file_date FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)")
def missing_lineage_dates(spark, sf_dir):
    ours = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("file_date"))
    return lineage.missing_dates(ours, read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").cast("string").alias("file_date")))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def dedupe_keep_last(spark, sf_dir):
    from tidemark.sources.files import keep_last

    return keep_last(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query(obs_sql("SELECT count(*) AS total_rows, count(*) FILTER (NOT is_open AND observed_wait IS NOT NULL) AS closed_with_wait, count(*) FILTER (age_ms < 0) AS negative_age, 0 AS unknown_mode, count(*) FILTER (is_single_rider) AS single_rider FROM cleaned").replace("0 AS unknown", "CAST(0 AS BIGINT) AS unknown"))
def invariants(spark, sf_dir):
    return lineage.violations(analysis(spark, sf_dir).cleaned)


@query(obs_sql("SELECT src_row, file_date, park_id, canonical_id, observed_wait FROM cleaned WHERE access_mode = 'standby' AND is_open AND training_eligibility = 'standby_wait_model'"))
def standby_view(spark, sf_dir):
    return lineage.standby_analysis(analysis(spark, sf_dir).cleaned).select("src_row", "file_date", "park_id", "canonical_id", "observed_wait")


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def idempotent_upsert(spark, sf_dir):
    new = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    stored = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return lineage.to_insert(new, stored, ["o_custkey"], "o_orderkey")


@query("SELECT count(DISTINCT o_custkey) AS planned, count(DISTINCT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey END) AS stored, planned = stored AS complete FROM orders")
def reconcile_counts(spark, sf_dir):
    planned, stored = read(spark, sf_dir, "orders").select("o_custkey"), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return lineage.reconciled(planned, stored, ["o_custkey"])


@query("""WITH h AS (SELECT sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) AS h FROM nation), b AS (SELECT left(h, 4) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM h GROUP BY 1) SELECT sha256(string_agg(h, ',' ORDER BY b, h)) AS signature FROM b""")
def data_signature(spark, sf_dir):
    return items.signature(read(spark, sf_dir, "nation"), ["n_name", "n_regionkey"], "n_nationkey")


_ADVICE = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in zip(("s > 0", "d > 0", "k > 0", "a > 0", "true"), quality.ADVICE.values()))


@query(obs_sql(f"""SELECT file_date, concat_ws(chr(10), {_ADVICE}) AS recommendations FROM (SELECT file_date, count(*) FILTER (stale) AS s FROM cleaned GROUP BY 1)
    LEFT JOIN (SELECT file_date, count(*) AS d FROM (SELECT file_date, snapshot_ts, park_id, name FROM norm GROUP BY ALL HAVING count(*) > 1) GROUP BY 1) USING (file_date)
    LEFT JOIN (SELECT file_date, count(*) FILTER (candidate_count > 1) AS k FROM ready GROUP BY 1) USING (file_date) LEFT JOIN (SELECT file_date, count(*) FILTER (optimizer_use = 'availability_only') AS a FROM singles GROUP BY 1) USING (file_date)"""))
def recommendations(spark, sf_dir):
    found = analysis(spark, sf_dir)
    return quality.recommendations(found.cleaned, found.ready, found.singles, SETTINGS).withColumn("recommendations", F.array_join("recommendations", "\n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, bit_xor(h) AS x, CAST(sum(h) AS VARCHAR) AS s FROM (SELECT *, CAST('0x' || left(md5('{\"k\":' || l_orderkey || ',\"n\":' || l_linenumber || ',\"d\":' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || '}'), 15) AS BIGINT) AS h FROM lineitem) GROUP BY ALL")
def mergeable_signature(spark, sf_dir):
    """Signatures of groups, made of those of their parts by ship mode."""
    named = lambda made: [v.alias(k) for k, v in made.items()]
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_orderkey") % 16).alias("part"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("d"))
    keys = ["l_returnflag", "l_linestatus"]
    parts = rows.groupBy(*keys, "part").agg(*named(items.content_signature(["k", "n", "d"])))
    return parts.groupBy(*keys).agg(*named(items.merged_signature())).withColumn("s", F.col("s").cast("string"))
