"""Queries over feeds, files, listings and the backfill, made from the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import names, numbers, times
from tidemark.operators import assembly, backfill, items, lineage, listings, quality
from tidemark.operators.ordered import Ordered
from tidemark.plans import publish
from tidemark.plans.analyze import flat, report
from tidemark.plans.versions import Published
from tidemark.queries import SETTINGS, analysis, normal, obs_sql, query, read, schedule_table
from tidemark.sources import files
from tidemark.sources.events import event_observations
from tidemark.streaming.collect import STATE, gated, thinned
from tidemark.streaming.collect import changed_snapshots as changed
from tidemark.workspace import Workspace

ZONE, TODAY = "UTC", "2024-01-01"
BOX = {"north": 34.0, "south": 33.0, "west": -118.0, "east": -117.0}
_GRID = "34::DOUBLE - (34::DOUBLE - 33::DOUBLE) * ((({a} * 2 + {b}) % 5 + 0.5::DOUBLE) / 5) AS glat, -118::DOUBLE + (-117::DOUBLE - -118::DOUBLE) * ((({a} + {b}) % 5 + 0.5::DOUBLE) / 5) AS glon"


def _box():
    return {k: F.lit(v) for k, v in BOX.items()}


#: Records in a page of a park's documents.
PAGE = 500


def _documents(rows: DataFrame, field: str, record, order: str) -> DataFrame:
    """A park's records in order as pages of JSON, each with the number of its first record (``first``)."""
    placed = Ordered(rows.withColumn("_r", record), ["park_id"], [order]).ordinal("_n").frame().withColumn("first", F.expr(f"(_n - 1) div {PAGE} * {PAGE}"))
    told = placed.groupBy("park_id", "first").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_r"))), lambda x: x["_r"]).alias(field))
    return told.select("park_id", "first", F.to_json(F.struct(field)).alias("json"))


def _iso(hour, day: str = TODAY):
    return F.concat(F.lit(f"{day}T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":30:00Z"))


def _catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts as entities of parks by size: catalogue, live data and schedule as JSON documents."""
    part = read(spark, sf_dir, "part").withColumns({"park_id": F.concat(F.lit("k"), F.col("p_size") % 10), "key": F.col("p_partkey")})
    key, size = F.col("key"), F.col("p_size")
    kind = F.when(size % 4 == 0, "ATTRACTION").when(size % 4 == 1, "SHOW").when(size % 4 == 2, "RESTAURANT")
    place = F.when(key % 3 == 0, F.struct((size / 100 + 33).cast("string").alias("latitude"), (size / -100 - 117).alias("lng")))
    standby = lambda wait: F.struct(F.struct(wait.cast("double").alias("waitTime")).alias("STANDBY"))
    hour = size % 24
    own_shows = F.when(key % 6 == 1, F.array(F.struct(_iso(hour).alias("start"), _iso((hour + 1) % 24).alias("end"))))
    child = F.struct(
        F.concat(F.lit("e"), key).alias("id"), F.concat_ws(" ", "p_brand", (key % 400).cast("string")).alias("name"), kind.alias("entityType"), F.when(size % 3 == 0, F.col("p_brand")).alias("area"), F.when(key % 11 == 0, "Old Land").alias("land"),
        place.alias("location"), F.when(key % 7 == 0, standby(size + 7)).alias("queue"), F.when(key % 5 == 0, (size + 3).cast("double")).alias("waitTime"), own_shows.alias("showTimes"),
    )
    queue = F.when(key % 4 == 0, standby(size))
    shows = F.array(F.struct(F.when(key % 8 == 0, _iso(hour, "2024-01-02")).otherwise(_iso(hour)).alias("startTime"), F.when(key % 6 == 0, _iso(hour)).otherwise(_iso((hour + 1) % 24)).alias("endTime")))
    live = F.struct(F.concat(F.lit("e"), key).alias("id"), F.when(size > 25, "operating").otherwise("CLOSED").alias("status"), F.when(key % 10 == 0, "New Area").alias("area"), queue.alias("queue"), (size + 1).cast("double").alias("waitTime"), shows.alias("showtimes"))
    entry = F.struct(F.when(key % 5 > 0, F.concat(F.lit("e"), key)).alias("entityId"), F.lit(TODAY).alias("date"), F.when((key % 5 == 0) | (key % 4 < 3), _iso(size % 12)).alias("openingTime"), _iso(size % 12 + 8).alias("closingTime"))
    return {
        "children": files.children(_documents(part, "children", child, "key"), first_col="first"),
        "live": files.live_entities(_documents(part.where("p_partkey % 2 = 0"), "liveData", live, "key"), first_col="first"),
        "entries": files.schedule_entries(_documents(part.where("p_size % 4 = 1 or p_partkey % 50 = 0"), "schedule", entry, "key"), first_col="first"),
    }


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _catalog(spark, sf_dir)
    curated = read(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("position"), F.concat_ws(" ", "p_brand", (F.col("p_partkey") % 400).cast("string")).alias("name"), (F.col("p_size") + 0.25).alias("lat"), (F.col("p_size") - 0.25).alias("lon"))
    today = F.lit(TODAY).cast("date")
    hours = assembly.park_hours(told["entries"], today, ZONE, F.array(F.lit("08:00 - 22:00")))
    scheduled = assembly.schedule_times(told["entries"], hours, ZONE)
    return assembly.entity_items(told["children"], told["live"], scheduled, curated, hours, _box(), today, ZONE)


_CLOCK = "lpad(CAST({0} AS VARCHAR), 2, '0') || ':30'"
_ENTITY_SQL = f"""p AS (SELECT 'k' || p_size % 10 AS park_id, p_partkey AS key, row_number() OVER (PARTITION BY p_size % 10 ORDER BY p_partkey) - 1 AS position, * FROM part),
    en AS (SELECT park_id, CASE WHEN key % 5 > 0 THEN 'e' || key END AS id, CASE WHEN key % 5 = 0 OR key % 4 < 3 THEN p_size % 12 * 60 + 30 ELSE 0 END AS o, (p_size % 12 + 8) * 60 + 30 AS c,
        CASE WHEN key % 5 = 0 OR key % 4 < 3 THEN {_CLOCK.format('p_size % 12')} ELSE '00:00' END || ' - ' || {_CLOCK.format('p_size % 12 + 8')} AS t FROM p WHERE p_size % 4 = 1 OR key % 50 = 0),
    hr AS (SELECT park_id, o, c FROM en WHERE id IS NULL UNION ALL SELECT DISTINCT park_id, 480, 1320 FROM en e WHERE NOT EXISTS (SELECT 1 FROM en x WHERE x.park_id = e.park_id AND x.id IS NULL)),
    sc AS (SELECT park_id, id, string_agg(DISTINCT t, '|') AS t FROM en WHERE id IS NOT NULL AND EXISTS (SELECT 1 FROM hr WHERE hr.park_id = en.park_id AND CASE WHEN en.o < hr.o THEN en.o + 1440 ELSE en.o END BETWEEN hr.o - 30 AND hr.c + 45) GROUP BY ALL),
    cu AS (SELECT lower(p_brand || ' ' || p_partkey % 400) AS k, arg_min(p_size + 0.25, p_partkey) AS lat, arg_min(p_size - 0.25, p_partkey) AS lon FROM part WHERE p_partkey % 7 = 0 GROUP BY 1),
    it AS (SELECT p.*, 'e' || key AS id, p_brand || ' ' || key % 400 AS name, key % 2 = 0 AS live, p_size % 24 AS h, p_size % 24 * 60 + 30 AS m,
        CASE p_size % 4 WHEN 0 THEN 'attraction' WHEN 1 THEN 'entertainment' END AS category, {_GRID.format(a='position', b='0')} FROM p),
    sh AS (SELECT *, CASE WHEN (CASE WHEN live THEN key % 8 > 0 ELSE key % 6 = 1 END) AND category = 'entertainment' AND (NOT EXISTS (SELECT 1 FROM hr WHERE hr.park_id = it.park_id) OR EXISTS (SELECT 1 FROM hr WHERE hr.park_id = it.park_id AND CASE WHEN m < hr.o THEN m + 1440 ELSE m END BETWEEN hr.o - 30 AND hr.c + 45))
        THEN CASE WHEN key % 6 = 0 THEN {_CLOCK.format('h')} ELSE {_CLOCK.format('h')} || ' - ' || {_CLOCK.format('(h + 1) % 24')} END END AS shown_at FROM it WHERE category IS NOT NULL),
    entity AS (SELECT sh.park_id, sh.id, sh.name, category, CASE WHEN key % 11 = 0 THEN 'Old Land' WHEN live AND key % 10 = 0 THEN 'New Area' WHEN p_size % 3 = 0 THEN p_brand ELSE 'Uncategorized' END AS land, CASE WHEN NOT live THEN 'UNKNOWN' WHEN p_size > 25 THEN 'operating' ELSE 'CLOSED' END AS status,
        live AND p_size > 25 AS is_open, CASE WHEN live AND key % 4 = 0 THEN p_size WHEN key % 7 = 0 THEN p_size + 7 WHEN live THEN p_size + 1 WHEN key % 5 = 0 THEN p_size + 3 END::DOUBLE AS wait, CASE WHEN category = 'entertainment' THEN coalesce(shown_at, sc.t, '') ELSE '' END AS times,
        CASE WHEN key % 3 = 0 THEN p_size::DOUBLE / 100 + 33 WHEN cu.k IS NOT NULL THEN cu.lat::DOUBLE ELSE glat END AS lat, CASE WHEN key % 3 = 0 THEN p_size::DOUBLE / -100 - 117 WHEN cu.k IS NOT NULL THEN cu.lon::DOUBLE ELSE glon END AS lon,
        CASE WHEN key % 3 = 0 OR cu.k IS NOT NULL THEN 'curated' ELSE 'estimated' END AS location_source FROM sh LEFT JOIN sc ON sc.park_id = sh.park_id AND sc.id = sh.id LEFT JOIN cu ON cu.k = lower(sh.name))"""


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("park_id", "id", "name", "category", "land", "status", "is_open", "wait", F.array_join("times", "|").alias("times"), "lat", "lon", "location_source")


@query(f"WITH {_ENTITY_SQL} SELECT * FROM entity")
def item_assembly(spark, sf_dir):
    return _plain(_entities(spark, sf_dir))


@query(f"WITH {_ENTITY_SQL} SELECT count(*) FILTER (location_source <> 'estimated') AS shown, count(*) FILTER (location_source = 'estimated') AS hidden FROM entity")
def map_view(spark, sf_dir):
    return assembly.hidden_from_map(_entities(spark, sf_dir))


@query(f"WITH {_ENTITY_SQL} SELECT id, lat, lon FROM entity WHERE location_source <> 'estimated'")
def mappable_items(spark, sf_dir):
    return assembly.mappable(_entities(spark, sf_dir)).select("id", "lat", "lon")


@query(f"WITH {_ENTITY_SQL} SELECT id, times FROM entity WHERE category = 'entertainment' AND times <> ''")
def timed_entertainment(spark, sf_dir):
    return assembly.with_times(_entities(spark, sf_dir)).select("id", F.array_join("times", "|").alias("times"))


@query(f"WITH {_ENTITY_SQL} SELECT park_id, category, count(*) || ' items' AS title FROM entity GROUP BY ALL")
def column_titles(spark, sf_dir):
    return assembly.column_titles(_entities(spark, sf_dir))


def _queue_documents(spark, sf_dir) -> DataFrame:
    """Suppliers as rides of their nation's park: three lands, and some without one."""
    key = F.col("s_suppkey")
    ride = F.struct(key.cast("string").alias("id"), F.concat(F.lit("Ride "), key % 60).alias("name"), (F.col("s_acctbal") > 0).alias("is_open"), F.when(key % 9 > 0, F.floor(F.col("s_acctbal") / 100).cast("double")).alias("wait_time"))
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("park_id"), key.alias("key"), (key % 4).alias("land"), ride.alias("ride"))
    placed = Ordered(rows, ["park_id", "land"], ["key"]).ordinal("n").frame().withColumn("first_ride", F.expr(f"(n - 1) div {PAGE} * {PAGE}"))
    pages = placed.groupBy("park_id", "land", "first_ride").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "ride"))), lambda x: x["ride"]).alias("rides"))
    # A park has three lands at most; their numbers are those of the lands before them that have rides.
    lands = rows.where("land < 3").groupBy("park_id").agg(F.sort_array(F.collect_set("land")).alias("all"))
    number = F.size(F.filter(F.coalesce("all", F.array().cast("array<bigint>")), lambda x: x < F.col("land")))
    inside = F.when(F.col("land") < 3, F.array(F.struct(F.concat(F.lit("Land "), "land").alias("name"), "rides")))
    told = pages.join(lands, "park_id", "left").select("park_id", number.alias("first_land"), "first_ride", inside.alias("lands"), F.when(F.col("land") == 3, F.col("rides")).alias("rides"))
    return told.select("park_id", "first_land", "first_ride", F.to_json(F.struct("lands", "rides")).alias("json"))


_QUEUE_SQL = """s AS (SELECT 'n' || s_nationkey AS park_id, s_suppkey AS key, s_suppkey % 4 AS l, * FROM supplier),
    li AS (SELECT park_id, l, row_number() OVER (PARTITION BY park_id ORDER BY l) - 1 AS i FROM (SELECT DISTINCT park_id, l FROM s WHERE l < 3)),
    q AS (SELECT s.park_id, key, CASE WHEN l < 3 THEN 'Land ' || l ELSE 'Other' END AS land, CASE WHEN l < 3 THEN li.i ELSE (SELECT count(*) FROM li x WHERE x.park_id = s.park_id) END AS land_index,
        row_number() OVER (PARTITION BY s.park_id, l ORDER BY key) - 1 AS ride_index, 'Ride ' || key % 60 AS name, s_acctbal > 0 AS is_open, CASE WHEN key % 9 > 0 THEN floor(s_acctbal / 100) END AS wait FROM s LEFT JOIN li USING (park_id, l))"""


def _queue_rides(spark, sf_dir) -> DataFrame:
    return files.queue_feed(_queue_documents(spark, sf_dir), first_land_col="first_land", first_ride_col="first_ride")


@query(f"WITH {_QUEUE_SQL} SELECT park_id, land, CAST(land_index AS INT) AS land_index, CAST(ride_index AS INT) AS ride_index, CAST(key AS VARCHAR) AS ride_id, name AS ride_name, is_open, wait FROM q")
def queue_rides(spark, sf_dir):
    return _queue_rides(spark, sf_dir).drop("last_updated")


@query(f"""WITH {_QUEUE_SQL}, cu AS (SELECT 'ride ' || n_nationkey AS k, n_regionkey + 0.5 AS lat, n_nationkey + 0.5 AS lon FROM nation WHERE n_nationkey % 2 = 0), g AS (SELECT *, {_GRID.format(a='land_index', b='ride_index')} FROM q)
    SELECT park_id, 'queue-' || park_id || '-' || key AS id, name, 'attraction' AS category, land, CASE WHEN is_open THEN 'OPERATING' ELSE 'CLOSED' END AS status, is_open, wait, '' AS times,
        CASE WHEN cu.k IS NOT NULL THEN cu.lat::DOUBLE ELSE glat END AS lat, CASE WHEN cu.k IS NOT NULL THEN cu.lon::DOUBLE ELSE glon END AS lon, CASE WHEN cu.k IS NOT NULL THEN 'curated' ELSE 'estimated' END AS location_source FROM g LEFT JOIN cu ON cu.k = lower(name)""")
def queue_items(spark, sf_dir):
    key = F.col("n_nationkey")
    curated = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(key.alias("position"), F.concat(F.lit("Ride "), key).alias("name"), (F.col("n_regionkey") + 0.5).alias("lat"), (key + 0.5).alias("lon"))
    return _plain(assembly.queue_items(_queue_rides(spark, sf_dir), curated, _box()))


@query("SELECT 'a' AS park_id, c_custkey AS id FROM customer UNION ALL SELECT 'b', s_suppkey FROM supplier")
def all_parks(spark, sf_dir):
    one = read(spark, sf_dir, "customer").select(F.lit("a").alias("park_id"), F.col("c_custkey").alias("id"))
    return assembly.all_parks(one, read(spark, sf_dir, "supplier").select(F.lit("b").alias("park_id"), F.col("s_suppkey").alias("id")))


def _scratch(spark: SparkSession) -> str:
    """A new folder that all machines share; it goes when the driver ends."""
    return Workspace(spark, "files").root


@query(r"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS file_date, CAST(event_id AS VARCHAR) AS ride_id, 'He said "' || event_type || '",' || chr(10) || 'x' AS ride_name, value >= 50 AS is_open, CASE WHEN event_id % 7 = 0 THEN 0.0 WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 90 END::DOUBLE AS wait,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS snapshot_park_datetime, strftime(ts, '%Y-%m-%d') AS snapshot_park_date, 'UTC' AS snapshot_timezone, 'Soarin’ Across America' AS land FROM events""")
def daily_files(spark, sf_dir):
    """Events written as daily files with a byte order mark, quotes and line feeds, and read again with older rows' defaults."""
    ts, key = F.col("ts").cast("timestamp"), F.col("event_id")
    utc = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    told = {
        "snapshot_utc": utc, "park_id": F.lit("p"), "park_name": F.lit("P"), "land": F.lit("Soarin�?Across America"), "ride_id": key.cast("string"), "ride_name": F.concat(F.lit('He said "'), "event_type", F.lit('",\nx')),
        "is_open": F.when(F.col("value") >= 50, "True").otherwise("no"), "wait_time_minutes": F.when(key % 7 == 0, "").when(key % 11 == 0, "12d").otherwise((key % 90).cast("string")), "source_last_updated_utc": utc, "source_url": F.lit("u"),
    }
    rows = read(spark, sf_dir, "events").select(F.to_date(ts).cast("string").alias("file_date"), *[v.alias(k) for k, v in told.items()])
    folder = _scratch(spark)
    publish.export_csv(rows, folder, list(told))
    back = files.typed(files.with_legacy_defaults(files.raw_observations(spark, folder), SETTINGS), SETTINGS)
    return back.select("file_date", "ride_id", "ride_name", "is_open", "wait", "snapshot_park_datetime", "snapshot_park_date", "snapshot_timezone", "land")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'standby' WHEN event_id % 3 = 1 THEN 'virtual_queue' ELSE 'other' END AS mode, strftime(ts, '%H:%M') AS clock, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%H:%M') || ' - ' || strftime(ts + INTERVAL 90 MINUTE, '%H:%M') END AS span,
    CASE event_type WHEN 'click' THEN 'attraction' WHEN 'view' THEN 'entertainment' END AS category, event_type IN ('signup', 'view') AS open_state, floor(value)::DOUBLE AS strict_wait, value >= 10 AS strict_open,
    greatest(3::DOUBLE, least(97::DOUBLE, (value / 128 - 0.25::DOUBLE) / 0.5::DOUBLE * 100)) AS x, greatest(3::DOUBLE, least(97::DOUBLE, (0.75::DOUBLE - value / 128) / 0.5::DOUBLE * 100)) AS y, 'b|a' AS flags, CASE WHEN value >= 10 THEN '00:05|09:10' ELSE '09:10|23:00' END AS sorted FROM events""")
def scalar_forms(spark, sf_dir):
    ts, key = F.col("ts").cast("timestamp"), F.col("event_id")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("event_type") == "click", "ATTRACTION").when(F.col("event_type") == "view", "PARADE").otherwise("RESTAURANT")
    state = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "view", "Scheduled").otherwise("DOWN")
    mode = F.when(key % 3 == 0, "standby").when(key % 3 == 1, "virtual_queue").otherwise("lottery")
    box = {"north": F.lit(0.75), "south": F.lit(0.25), "west": F.lit(0.25), "east": F.lit(0.75)}
    span = assembly.range_text(iso(ts), F.when(key % 2 == 1, iso(ts + F.expr("INTERVAL 90 MINUTE"))).otherwise(iso(ts)), ZONE)
    clocks = F.when(F.col("value") >= 10, F.array(F.lit("9:10"), F.lit("00:05"), F.lit("9:10"))).otherwise(F.array(F.lit("23:00"), F.lit("9:10")))
    return read(spark, sf_dir, "events").select(
        "event_id", lineage.access_mode(mode).alias("mode"), times.clock_text(iso(ts), ZONE).alias("clock"), span.alias("span"), items.category(kind).alias("category"), items.is_open_state(state).alias("open_state"),
        numbers.strict(F.floor("value").cast("string"), "wait").alias("strict_wait"), numbers.strict_bool(F.when(F.col("value") >= 10, "TRUE").otherwise("false"), "open").alias("strict_open"),
        *items.projected(F.col("value") / 128, F.col("value") / 128, box), F.array_join(backfill.flag_array(F.lit("b||a|")), "|").alias("flags"),
        F.array_join(F.transform(times.sorted_times(clocks), lambda t: F.lpad(t, 5, "0")), "|").alias("sorted"),
    )


@query(obs_sql("SELECT src_row, CASE WHEN age_tenths IS NULL THEN '' ELSE (CASE WHEN age_tenths < 0 THEN '-' ELSE '' END) || abs(age_tenths) // 10 || '.' || abs(age_tenths) % 10 END AS source_age_minutes, flags AS quality_flags FROM cleaned"))
def flat_rows(spark, sf_dir):
    return flat(analysis(spark, sf_dir).cleaned).select("src_row", "source_age_minutes", "quality_flags")


@query(obs_sql("SELECT file_date, park_id, ride_key, floor(closed_rows / total_rows * 1000 + 0.5) / 1000 AS closed_ratio, row_number() OVER (ORDER BY file_date, floor(closed_rows / total_rows * 1000 + 0.5) DESC, park_id, ride_key) AS nth FROM rides WHERE possible_full_day_closed"))
def full_day_closed(spark, sf_dir):
    return _numbered(listings.full_day_closed(analysis(spark, sf_dir).rides).select("file_date", "park_id", "ride_key", "closed_ratio"))


@query(obs_sql("SELECT file_date, park_id, ride_key, transitions, row_number() OVER (ORDER BY file_date, transitions DESC, park_id, ride_key) AS nth FROM rides WHERE temporary_downtime"))
def downtimes(spark, sf_dir):
    return _numbered(listings.downtimes(analysis(spark, sf_dir).rides).select("file_date", "park_id", "ride_key", "transitions"))


@query(obs_sql("SELECT *, row_number() OVER (ORDER BY file_date, max_age_tenths DESC, park_id, ride_name) AS nth FROM (SELECT file_date, park_id, ride_name, count(*) AS stale_rows, max(age_tenths) AS max_age_tenths FROM cleaned WHERE stale GROUP BY ALL)"))
def stale_in_order(spark, sf_dir):
    return _numbered(listings.stale_in_order(quality.stale_sources(normal(spark, sf_dir), SETTINGS)))


@query(obs_sql("SELECT file_date, park_id, base, optimizer_use, row_number() OVER (ORDER BY file_date, park_id, base) AS nth FROM singles"))
def single_riders_in_order(spark, sf_dir):
    return _numbered(listings.single_riders_in_order(analysis(spark, sf_dir).singles).select("file_date", "park_id", "base", "optimizer_use"))


@query(obs_sql("SELECT src_row, row_number() OVER (ORDER BY snapshot_ts, park_id, canonical_id, access_mode) AS nth FROM ready"))
def optimizer_in_order(spark, sf_dir):
    return _numbered(listings.optimizer_order(analysis(spark, sf_dir).ready).select("src_row"))


@query(obs_sql("SELECT file_date, snapshot_ts, string_agg(DISTINCT park_id, ',' ORDER BY park_id) AS parks, row_number() OVER (ORDER BY snapshot_ts) AS nth FROM norm GROUP BY file_date, snapshot_ts"))
def snapshots_in_order(spark, sf_dir):
    return _numbered(listings.snapshots_in_order(normal(spark, sf_dir)).withColumn("parks", F.array_join("parks", ",")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Sorted rows with their place: the number within the partition plus the rows of those before. The sorted rows are written once, so both readings number alike."""
    placed = Workspace(rows.sparkSession, "sorted").table(rows.withColumn("_id", F.monotonically_increasing_id()), "rows")
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("k"))
    # One row for each partition.
    before = sizes.select("_part", (F.sum("k").over(Window.orderBy("_part")) - F.col("k")).alias("_base"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("nth", F.col("_base") + inside + 1).drop("_id", "_part", "_base")


_HOURS = "SELECT DISTINCT file_date, 'p0' AS park_id, CAST(file_date AS TIMESTAMP) + INTERVAL 6 HOUR AS opens, CAST(file_date AS TIMESTAMP) + INTERVAL 17 HOUR AS closes FROM norm WHERE day(CAST(file_date AS DATE)) % 5 <> 0"


@query(obs_sql(f"""SELECT file_date, snapshot_ts, park_id, expected FROM (SELECT s.file_date, s.snapshot_ts, p.park_id, CASE WHEN h.file_date IS NULL THEN true ELSE s.snapshot_ts BETWEEN opens - INTERVAL 30 MINUTE AND closes + INTERVAL 60 MINUTE END AS expected,
    row_number() OVER (PARTITION BY s.file_date ORDER BY s.snapshot_ts DESC, p.park_id DESC) AS nth FROM (SELECT DISTINCT file_date, snapshot_ts FROM norm) s CROSS JOIN (SELECT DISTINCT park_id FROM norm) p LEFT JOIN ({_HOURS}) h ON h.park_id = p.park_id AND h.file_date = s.file_date) WHERE nth <= 5"""))
def last_checks(spark, sf_dir):
    return listings.last_checks(analysis(spark, sf_dir).gaps, 5).select("file_date", "snapshot_ts", "park_id", "expected")


@query(obs_sql("""SELECT c.file_date, c.file_date || ': rows=' || count(*) || ' snapshots=' || count(DISTINCT snapshot_ts) || ' closed=' || count(*) FILTER (NOT is_open) || ' zero=' || count(*) FILTER (wait = 0) || ' stale=' || count(*) FILTER (stale)
    || ' duplicates=' || coalesce(any_value(d.n), 0) || ' singleRiderUsable=' || coalesce(any_value(s.n), 0) || ' optimizerReady=' || coalesce(any_value(r.n), 0) AS line FROM cleaned c
    LEFT JOIN (SELECT file_date, count(*) AS n FROM (SELECT file_date, snapshot_ts, park_id, name FROM norm GROUP BY ALL HAVING count(*) > 1) GROUP BY 1) d ON d.file_date = c.file_date
    LEFT JOIN (SELECT file_date, count(*) FILTER (optimizer_use = 'use_wait_reference') AS n FROM singles GROUP BY 1) s ON s.file_date = c.file_date LEFT JOIN (SELECT file_date, count(*) AS n FROM ready GROUP BY 1) r ON r.file_date = c.file_date GROUP BY c.file_date"""))
def console_lines(spark, sf_dir):
    found = analysis(spark, sf_dir)
    doubled = found.cleaned.groupBy("file_date", "snapshot_ts", "park_id", "name").count().where("count > 1").groupBy("file_date").agg(F.count(F.lit(1)).alias("duplicates"))
    singles = quality.single_rider_summary(found.singles).select("file_date", "usable_groups")
    return listings.console_lines(quality.summary(found.cleaned, SETTINGS), doubled, singles, quality.optimizer_summary(found.ready).select("file_date", "ready_rows"))


@query(obs_sql("SELECT file_date, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_local, string_agg(park_id || '=' || n, ',' ORDER BY park_id) AS parks FROM (SELECT file_date, snapshot_ts, park_id, count(*) AS n FROM norm GROUP BY ALL) GROUP BY ALL"))
def parks_by_snapshot(spark, sf_dir):
    found = quality.parks_by_snapshot(quality.snapshot_park_summary(normal(spark, sf_dir), SETTINGS))
    said = F.transform(F.array_sort(F.map_entries("parks")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["total_rows"].cast("string")))
    return found.select("file_date", "snapshot_local", F.array_join(said, ",").alias("parks"))


@query(obs_sql(f"SELECT file_date, park_id, count(*) AS n FROM norm SEMI JOIN ({_HOURS.replace('file_date,', 'file_date AS day,', 1)}) h ON h.park_id = norm.park_id AND norm.snapshot_ts BETWEEN h.opens - INTERVAL 30 MINUTE AND h.closes + INTERVAL 60 MINUTE GROUP BY ALL"))
def gated_observations(spark, sf_dir):
    return gated(event_observations(spark, sf_dir), schedule_table(spark, sf_dir), SETTINGS).groupBy("file_date", "park_id").agg(F.count(F.lit(1)).alias("n"))


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Raw rows of an archive a day, and the normalised rows that come from them; every ninth is of another version."""
    rows = analysis(spark, sf_dir).cleaned
    raw_id = lineage.content_id(F.col("file_date"), F.col("src_row").cast("string")).alias("raw_observation_id")
    raw = event_observations(spark, sf_dir).select(raw_id, F.col("file_date").alias("raw_archive_id"), "park_id", "land", F.when(F.col("src_row") % 2 >= 0, "America/Los_Angeles").alias("snapshot_timezone"))
    version = F.when(F.col("src_row") % 9 == 0, "v2").otherwise("v1").alias("transformation_version")
    return raw, rows.select(raw_id, "file_date", F.col("src_row").alias("position"), "canonical_id", "canonical_name", "category", "access_mode", "is_open", "observed_wait", "training_eligibility", version)


_RAW_ID = "sha256(file_date || ':' || src_row)"


@query(obs_sql(f"SELECT {_RAW_ID} AS raw_observation_id, park_id, canonical_id FROM cleaned"))
def normalized_parks(spark, sf_dir):
    raw, rows = _stored(spark, sf_dir)
    return backfill.with_park(rows, raw).select("raw_observation_id", "park_id", "canonical_id")


@query(obs_sql(f"SELECT {_RAW_ID} AS raw_observation_id, park_id, canonical_id, observed_wait, 'Land ' || user_id % 3 AS land FROM cleaned JOIN obs0 ON event_id = src_row WHERE access_mode = 'standby' AND is_open AND training_eligibility = 'standby_wait_model'"))
def standby_joined(spark, sf_dir):
    raw, rows = _stored(spark, sf_dir)
    return backfill.standby_view(rows, raw).select("raw_observation_id", "park_id", "canonical_id", "observed_wait", "land")


@query(obs_sql("SELECT count(*) AS raw_count, count(*) FILTER (src_row % 9 <> 0) AS normalized_count FROM cleaned WHERE day(CAST(file_date AS DATE)) % 2 = 0"))
def stored_counts(spark, sf_dir):
    raw, rows = _stored(spark, sf_dir)
    archives = raw.select("raw_archive_id").distinct().where("day(to_date(raw_archive_id)) % 2 = 0")
    return backfill.stored_counts(raw, rows, archives, "v1")


@query(obs_sql("""SELECT (SELECT count(DISTINCT file_date) FROM norm) AS raw_archives, count(*) AS raw_observations, CAST(0 AS BIGINT) AS invalid_timezones, count(*) AS normalized_observations, count(DISTINCT file_date) AS normalized_dates, count(*) FILTER (is_single_rider) AS single_rider,
    count(*) FILTER (access_mode = 'standby' AND is_open AND observed_wait IS NOT NULL AND training_eligibility = 'standby_wait_model') AS standby_analysis, CAST(0 AS BIGINT) AS closed_with_wait, (SELECT count(*) FROM nation) AS aliases FROM cleaned"""))
def backfill_counts(spark, sf_dir):
    raw, rows = _stored(spark, sf_dir)
    return backfill.plan_counts(raw.select("raw_archive_id").distinct(), raw, rows, read(spark, sf_dir, "nation"))


@query(obs_sql("""SELECT canonical_id, coalesce(n.n_name, arg_max(c.canonical_name, src_row)) AS canonical_name, CASE WHEN n.n_name IS NULL THEN arg_max(c.category, src_row) ELSE 'attraction' END AS category FROM cleaned c LEFT JOIN nation n ON c.canonical_id = 'p' || n.n_regionkey % 2 || '-coaster-and-loop-' || n.n_nationkey GROUP BY canonical_id, n.n_name
    UNION ALL SELECT 'p' || n_regionkey % 2 || '-coaster-and-loop-' || n_nationkey, n_name, 'attraction' FROM nation WHERE 'p' || n_regionkey % 2 || '-coaster-and-loop-' || n_nationkey NOT IN (SELECT canonical_id FROM cleaned)"""))
def stored_attractions(spark, sf_dir):
    raw, rows = _stored(spark, sf_dir)
    park = F.concat(F.lit("p"), F.col("n_regionkey") % 2)
    aliases = read(spark, sf_dir, "nation").select(F.concat(park, F.lit("-coaster-and-loop-"), "n_nationkey").alias("canonical_id"), F.col("n_nationkey").alias("position"), park.alias("park_id"), F.col("n_name").alias("canonical_name"), F.lit("attraction").alias("category"))
    return backfill.attractions(backfill.with_park(rows, raw), aliases).select("canonical_id", "canonical_name", "category")


@query("""SELECT n_name AS park, e AS endpoint, 'https://feeds.example/v1/' || n_nationkey || '/' || e AS url, 'cache/n' || n_nationkey || '.' || e || '.json' AS file FROM nation, unnest(['live', 'children']) t(e)""")
def cache_manifest(spark, sf_dir):
    parks = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("park_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("entity_id"))
    return publish.manifest(parks, ["live", "children"], "https://feeds.example/v1/", "cache/")


@query(obs_sql("SELECT strftime(max(snapshot_ts), '%Y-%m-%d %H:%M:%S') AS snapshot_utc, count(*) FILTER (snapshot_ts = (SELECT max(snapshot_ts) FROM obs)) AS n_rows FROM obs"))
def latest_snapshot(spark, sf_dir):
    rows = event_observations(spark, sf_dir).select(F.date_format("snapshot_ts", "yyyy-MM-dd HH:mm:ss").alias("snapshot_utc"), "park_id", "ride_id", "ride_name", "wait", "src_row")
    told = publish.latest_snapshot(rows, ["closed park"])
    return told.select(F.get_json_object("json", "$.snapshot_utc").alias("snapshot_utc"), F.size(F.from_json(F.get_json_object("json", "$.rows"), "array<struct<src_row: long>>")).cast("long").alias("n_rows"))


@query("SELECT n_nationkey, 'nation' AS row_type, CASE WHEN n_nationkey % 3 = 0 THEN 'snapshot_utc,park_id' ELSE '' END AS missing, n_nationkey % 5 = 0 AS wrong_zone FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 5 = 0")
def raw_problems(spark, sf_dir):
    key = F.col("n_nationkey")
    cells = {c: F.lit("x") for c in lineage.REQUIRED} | {"snapshot_utc": F.when(key % 3 == 0, "").otherwise("x"), "park_id": F.when(key % 3 > 0, "x"), "snapshot_timezone": F.when(key % 5 == 0, "UTC").otherwise("America/Los_Angeles")}
    raw = read(spark, sf_dir, "nation").select(key.alias("src_row"), F.lit("d").alias("file_date"), *[v.alias(k) for k, v in cells.items()])
    return lineage.problems(raw).select(F.col("src_row").alias("n_nationkey"), F.lit("nation").alias("row_type"), F.array_join("missing", ",").alias("missing"), "wrong_zone")


@query("""WITH e AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS file_date, CASE WHEN day(ts) % 3 = 0 THEN 13 ELSE 14 END AS width FROM events)
    SELECT file_date, count(*) AS records, count(*) FILTER (event_id % 10 = 1) AS short, count(*) FILTER (event_id % 10 = 2) AS long, count(*) FILTER (event_id % 13 = 0) AS bad_instants,
        count(*) FILTER (event_id % 11 = 0) AS bad_waits, count(*) FILTER (value < 10) AS unknown_status FROM e GROUP BY file_date""")
def damaged_files(spark, sf_dir):
    """Events as daily files of two widths with ragged rows, quoted commas, bad instants, waits and states, and what is found of them."""
    ts, key = F.col("ts").cast("timestamp"), F.col("event_id")
    wide = F.dayofmonth(ts) % 3 != 0
    utc = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    quoted = F.concat(F.lit('"He said ""'), "event_type", F.lit('"", twice"'))
    cells = [F.when(key % 13 == 0, "soon").otherwise(utc), *[F.lit(x) for x in ("", "", "UTC", "p", "P", "L")], key.cast("string"), quoted,
        F.when(F.col("value") < 10, "maybe").otherwise("True"), F.when(key % 11 == 0, "12d").otherwise("5"), utc, F.lit("")]
    line = F.concat_ws(",", *cells[:12], *[F.when(key % 10 != 1, c) for c in [F.lit("")]], F.when((key % 10 != 1) & wide, "u"), F.when(key % 10 == 2, "more"))
    # A row that is short lacks the last cells.
    rows = read(spark, sf_dir, "events").select(F.to_date(ts).cast("string").alias("file_date"), key.alias("at"), line.alias("line"), wide.alias("wide"))
    heads = rows.select("file_date", "wide").distinct().select("file_date", F.lit(-1).cast("long").alias("at"), F.when(F.col("wide"), ",".join(files.RAW_COLUMNS)).otherwise(",".join(files.RAW_COLUMNS[:-1])).alias("line"))
    folder = _scratch(spark)
    publish.export_lines(rows.drop("wide").unionByName(heads), folder, "line", "at")
    return files.damage(spark, folder, settings=SETTINGS)


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'array' WHEN 1 THEN 'absent' WHEN 2 THEN 'other' WHEN 3 THEN 'broken' ELSE 'other' END AS state, CASE o_orderkey % 5 WHEN 0 THEN 2 ELSE 0 END AS n FROM orders")
def damaged_documents(spark, sf_dir):
    """Catalogue documents with arrays, none, a text, half a document, or an object where the array should be, and the records read of each."""
    key = F.col("o_orderkey")
    told = F.when(key % 5 == 0, '{"children": [{"id": "a"}, {"id": "b"}]}').when(key % 5 == 1, '{"x": 1}').when(key % 5 == 2, '{"children": "none"}').when(key % 5 == 3, '{"children": [{"id": ').otherwise('{"children": {"id": "a"}}')
    rows = read(spark, sf_dir, "orders").select(key.alias("park_id"), told.alias("json"))
    counted = files.children(rows).groupBy("park_id").agg(F.count(F.lit(1)).alias("k"))
    return rows.join(counted, "park_id", "left").select(F.col("park_id").alias("o_orderkey"), files.document_state(F.col("json"), "children").alias("state"), F.coalesce("k", F.lit(0)).cast("int").alias("n"))


@query("""SELECT 'p' || s_suppkey % 3 AS park_id, 'ride and ' || s_suppkey % 40 AS alias, 'c' || s_suppkey % 120 AS canonical_id, 'Ride, ' || s_suppkey % 120 AS canonical_name, CASE WHEN s_suppkey % 4 = 0 THEN 'attraction' ELSE 'show' END AS category FROM supplier GROUP BY ALL""")
def alias_files(spark, sf_dir):
    """Suppliers as an alias catalogue written as CSV and read again: names in comparable form, one row for each park and alias."""
    key = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(
        F.lit("all").alias("file_date"), F.concat(F.lit("p"), key % 3).alias("park_id"), F.concat(F.when(key % 2 == 0, "Ride & ").otherwise("RIDE and "), key % 40).alias("alias_name"),
        F.concat(F.lit("c"), key % 120).alias("canonical_attraction_id"), F.concat(F.lit("Ride, "), key % 120).alias("canonical_name"), F.when(key % 4 == 0, "").otherwise("show").alias("category"), F.lit("a \"note\"").alias("notes"),
    )
    folder = _scratch(spark)
    publish.export_csv(rows, folder, files.ALIAS_COLUMNS, name="aliases")
    return files.aliases(files.read_csv(spark, f"{folder}/aliases_all.csv"))


@query("""SELECT 'k' || o_custkey % 7 AS park_id, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1 AS position, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 HOUR AS opens,
    CAST(o_orderdate AS TIMESTAMP) + INTERVAL 22 HOUR AS closes, o_orderkey FROM orders QUALIFY o_orderkey % 6 > 0""".replace(", o_orderkey FROM", " FROM"))
def schedule_files(spark, sf_dir):
    """Orders as days of schedule documents: the usable entries, with the date of the opening where there is none."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    iso = lambda hour: F.concat(day, F.lit(f"T{hour:02}:00:00Z"))
    entry = F.struct(F.when(key % 4 > 0, day).alias("date"), F.when(key % 6 > 0, iso(9)).otherwise("soon").alias("openingTime"), iso(22).alias("closingTime"))
    rows = read(spark, sf_dir, "orders").withColumn("park_id", F.concat(F.lit("k"), F.col("o_custkey") % 7))
    found = files.schedules(_documents(rows, "schedule", entry, "o_orderkey"), settings=SETTINGS, first_col="first")
    return found.select("park_id", F.col("position").cast("long").alias("position"), "date", "opens", "closes")


@query(obs_sql(f"""SELECT c.file_date, count(*) AS total_rows, any_value(r.n) AS ready_rows, any_value(f.n) AS full_day_closed, any_value(f.d) AS downtime, any_value(d.n) AS duplicate_groups, any_value(k.n) AS conflict_groups FROM cleaned c
    LEFT JOIN (SELECT file_date, count(*) AS n FROM ready GROUP BY 1) r ON r.file_date = c.file_date LEFT JOIN (SELECT file_date, count(*) FILTER (possible_full_day_closed) AS n, count(*) FILTER (temporary_downtime) AS d FROM rides GROUP BY 1) f ON f.file_date = c.file_date
    LEFT JOIN (SELECT file_date, count(*) AS n FROM (SELECT file_date, snapshot_ts, park_id, name FROM norm GROUP BY ALL HAVING count(*) > 1) GROUP BY 1) d ON d.file_date = c.file_date
    LEFT JOIN (SELECT file_date, count(*) AS n FROM (SELECT file_date, snapshot_ts, park_id, canonical_id, access_mode FROM norm GROUP BY ALL HAVING count(*) > 1) GROUP BY 1) k ON k.file_date = c.file_date GROUP BY c.file_date"""))
def report_files(spark, sf_dir):
    """The report published as one version and read back."""
    store = Published(spark, _scratch(spark))
    store.publish({"report": report(analysis(spark, sf_dir))}, by={"report": "file_date"})
    return store.read("report").select("file_date", "summary.total_rows", "optimizer.ready_rows", "full_day_closed", "downtime", "duplicate_groups", "conflict_groups")


@query("SELECT c_custkey, 's3://bucket/wait-times/' || sha256(c_name) || '/' || c_custkey || '.csv' AS object_uri FROM customer")
def assumed_uris(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    return rows.select("c_custkey", lineage.object_uri(F.lit("s3://bucket/"), F.sha2(F.col("c_name").cast("binary"), 256), F.concat(F.col("c_custkey").cast("string"), F.lit(".csv"))).alias("object_uri"))


@query("SELECT file_date, row_number() OVER (ORDER BY file_date) AS nth, n FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS file_date, sum(length(event_type) + 1) + 5 AS n FROM events GROUP BY 1)")
def file_listing(spark, sf_dir):
    """Daily files in order of their dates, with their size in bytes (a mark of three, a name and a line feed, then lines)."""
    rows = read(spark, sf_dir, "events").select(F.to_date(F.col("ts").cast("timestamp")).cast("string").alias("file_date"), F.col("event_type").alias("x"))
    folder = _scratch(spark)
    publish.export_csv(rows, folder, ["x"])
    sizes = lineage.archives(spark.read.format("binaryFile").load(folder)).select("path", F.col("byte_size").alias("n"))
    # A row for each file and few of them.
    placed = files.observation_files(spark, folder).join(sizes, "path").withColumn("nth", F.row_number().over(Window.orderBy("file_date")).cast("long"))
    return placed.select("file_date", "nth", "n")


@query("""SELECT event_id, sha256('archive:' || event_id) AS raw_observation_id, ts AS snapshot_ts, value >= 10 AS open, CASE WHEN event_id % 7 > 0 THEN floor(value)::DOUBLE END AS wait FROM events""")
def typed_records(spark, sf_dir):
    ts, key = F.col("ts").cast("timestamp"), F.col("event_id")
    utc = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    raw = read(spark, sf_dir, "events").select("event_id", utc.alias("snapshot_utc"), utc.alias("source_last_updated_utc"), F.when(F.col("value") >= 10, "TRUE").otherwise("FALSE").alias("is_open"), F.when(key % 7 > 0, F.floor("value").cast("string")).otherwise("").alias("wait_time_minutes"))
    return lineage.raw_records(raw, F.lit("archive"), key).select("event_id", "raw_observation_id", "snapshot_ts", "open", "wait")


@query("SELECT event_id, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS park_date FROM events")
def park_dates(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", assembly.park_date(F.col("ts").cast("timestamp"), "America/Los_Angeles").alias("park_date"))


@query(obs_sql("""s AS (SELECT DISTINCT CAST(CAST(snapshot_ts AS DATE) AS VARCHAR) AS service_date, snapshot_ts FROM obs), RECURSIVE_MARK
    SELECT k.service_date, k.snapshot_ts, count(*) AS n FROM k JOIN obs o ON o.snapshot_ts = k.snapshot_ts GROUP BY ALL""").replace("\ns AS", ",\ns AS").replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_MARK", """k AS (SELECT service_date, min(snapshot_ts) AS snapshot_ts FROM s GROUP BY 1
    UNION ALL SELECT * FROM (SELECT k.service_date, (SELECT min(s.snapshot_ts) FROM s WHERE s.service_date = k.service_date AND s.snapshot_ts >= k.snapshot_ts + INTERVAL 10 HOUR) AS snapshot_ts FROM k) WHERE snapshot_ts IS NOT NULL)"""))
def thinned_snapshots(spark, sf_dir):
    """The snapshots of each date that are ten hours apart at least, as the stream keeps them."""
    rows = event_observations(spark, sf_dir).withColumn("service_date", F.to_date("snapshot_ts").cast("string"))
    none = spark.createDataFrame([], "service_date string, snapshot_ts timestamp")
    return thinned(rows, none, Settings(min_interval_minutes=600)).groupBy("service_date", "snapshot_ts").agg(F.count(F.lit(1)).alias("n"))


@query(obs_sql("""SELECT park_id, snapshot_ts, n FROM (SELECT *, told IS DISTINCT FROM lag(told) OVER (PARTITION BY park_id ORDER BY snapshot_ts) OR lag(told) OVER (PARTITION BY park_id ORDER BY snapshot_ts) IS NULL AS changed FROM
    (SELECT park_id, snapshot_ts, count(*) AS n, string_agg(is_open, ',' ORDER BY is_open) AS told FROM (SELECT * FROM obs WHERE ride_id = '3') GROUP BY ALL)) WHERE changed"""))
def changed_snapshots(spark, sf_dir):
    """The snapshots of one ride whose states differ from those of the snapshot before, by signatures that need no order."""
    none = spark.createDataFrame([], STATE["signatures"])
    rows, _ = changed(event_observations(spark, sf_dir).where("ride_id = '3'"), none, ["is_open"])
    return rows.groupBy("park_id", "snapshot_ts").agg(F.count(F.lit(1)).alias("n"))
