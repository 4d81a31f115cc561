"""Observation files, catalogues, schedules and feeds as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import names, numbers, times

# The columns of the daily observation files, in order.
RAW_COLUMNS = [
    "snapshot_utc", "snapshot_park_datetime", "snapshot_park_date", "snapshot_timezone", "park_id", "park_name", "land", "ride_id", "ride_name",
    "is_open", "wait_time_minutes", "source_last_updated_utc", "source_last_updated_park_datetime", "source_url",
]
ALIAS_COLUMNS = ["park_id", "alias_name", "canonical_attraction_id", "canonical_name", "category", "notes"]
FILE_DATE = r"wait_times_(\d{4}-\d{2}-\d{2})\.csv$"


def read_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text columns by header, with byte order mark, doubled quotes and line feeds in quotes; missing cells are empty, empty rows go."""
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", inferSchema=False).csv(list(paths) if not isinstance(paths, str) else paths)
    return rows.na.drop("all")


def observation_files(spark: SparkSession, folder: str, date: str | None = None) -> DataFrame:
    """(path, file_date) of the daily files, in order; a date restricts them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"wait_times_{date or '*'}.csv").load(folder)
    dated = found.select("path", F.regexp_extract("path", FILE_DATE, 1).alias("file_date"))
    return dated.where("file_date <> ''").orderBy("file_date")


def raw_observations(spark: SparkSession, folder: str, date: str | None = None) -> DataFrame:
    """All 14 columns as text with file_date and src_row, the order of rows within the file.

    Files lack trailing columns in older layouts; those are empty. A date restricts the scan to its file.
    """
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"', enforceSchema=False, pathGlobFilter=f"wait_times_{date or '*'}.csv").csv(folder)
    rows = rows.withColumn("file_date", F.regexp_extract(F.col("_metadata.file_path"), FILE_DATE, 1)).where("file_date <> ''")
    have = set(rows.columns)
    cells = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in RAW_COLUMNS]
    kept = rows.na.drop("all", subset=[c for c in RAW_COLUMNS if c in have])
    return kept.select(*cells, "file_date", F.monotonically_increasing_id().alias("src_row"))


_BROKEN = "_broken"


def damage(spark: SparkSession, folder: str, date: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """(file_date, records, short, long, bad_instants, bad_waits, unknown_status) of the daily files: what ``raw_observations`` and ``typed`` read leniently.

    A record is short or long if it has fewer or more cells than its file's header; missing cells are read as empty, surplus
    ones are not read. Instants and waits that can't be read count unless they are empty, and so does a status that is neither
    true nor false. Rows without any value are no records.
    """
    schema = ", ".join(f"{c} string" for c in [*RAW_COLUMNS, _BROKEN])
    options = {"header": False, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN, "columnPruning": False, "pathGlobFilter": f"wait_times_{date or '*'}.csv"}
    rows = spark.read.schema(schema).options(**options).csv(folder).withColumn("file_date", F.regexp_extract(F.col("_metadata.file_path"), FILE_DATE, 1)).where("file_date <> ''")
    # Of a record with another number of cells than there are columns the text is known; cells in quotes may hold commas.
    cells = F.when(F.col(_BROKEN).isNull(), len(RAW_COLUMNS)).otherwise(F.size(F.split(F.regexp_replace(_BROKEN, '"(?:[^"]|"")*"', "x"), ",")))
    head = F.ltrim(F.col(RAW_COLUMNS[0]), F.lit("\ufeff")) == RAW_COLUMNS[0]
    rows = rows.withColumns({"cells": cells, "head": F.coalesce(head, F.lit(False))})
    heads = rows.where("head").groupBy("file_date").agg(F.max("cells").alias("width"))
    records = rows.where("not head").na.drop("all", subset=RAW_COLUMNS).join(heads, "file_date", "left").withColumn("width", F.coalesce("width", F.lit(len(RAW_COLUMNS))))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    bad = (filled("snapshot_utc") & F.try_to_timestamp("snapshot_utc").isNull()) | (filled("source_last_updated_utc") & F.try_to_timestamp("source_last_updated_utc").isNull())
    return records.groupBy("file_date").agg(
        F.count(F.lit(1)).alias("records"), count(F.col("cells") < F.col("width")).alias("short"), count(F.col("cells") > F.col("width")).alias("long"), count(bad).alias("bad_instants"),
        count(filled("wait_time_minutes") & numbers.lenient(F.col("wait_time_minutes"), settings.blank_as_zero).isNull()).alias("bad_waits"), count(~F.upper("is_open").isin("TRUE", "FALSE")).alias("unknown_status"),
    )


def document_state(json: Column, field: str) -> Column:
    """What a JSON document has under a field that should be an array: array, absent, other, or that it is no JSON at all (broken). All but arrays are read as without records."""
    value = F.try_parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
    return F.when(value.isNull(), "broken").when(kind.startswith("ARRAY"), "array").when(kind.isNull() | (kind == "VOID"), "absent").otherwise("other")


def with_legacy_defaults(raw: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Older rows get the local times, date and zone that follow from their instants; damaged names are repaired."""
    snapshot, source = F.try_to_timestamp("snapshot_utc"), F.try_to_timestamp("source_last_updated_utc")
    derived = {
        "snapshot_park_datetime": times.local_text(snapshot, settings.zone),
        "snapshot_park_date": times.local_date(snapshot, settings.zone).cast("string"),
        "snapshot_timezone": F.lit(settings.zone),
        "source_last_updated_park_datetime": times.local_text(source, settings.zone),
    }
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), v, F.lit("")) for c, v in derived.items()}
    return raw.withColumns(filled | {c: names.repaired(F.col(c)) for c in ("land", "ride_name")})


def typed(raw: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The columns that the operators work on: instants, whether open, the wait. What can't be read is null, an unknown status closed."""
    return raw.withColumns(
        {
            "snapshot_ts": F.try_to_timestamp("snapshot_utc"),
            "source_ts": F.try_to_timestamp("source_last_updated_utc"),
            "is_open": F.upper("is_open") == "TRUE",
            "wait": numbers.lenient(F.col("wait_time_minutes"), settings.blank_as_zero),
        }
    )


def aliases(rows: DataFrame) -> DataFrame:
    """(park_id, alias, canonical_id, canonical_name, category), one row for each park and alias: the last in the file's order."""
    rows = rows.withColumn("_order", F.monotonically_increasing_id()).withColumn("alias", names.catalog_name(F.col("alias_name")))
    rows = rows.where("coalesce(park_id, '') <> '' and alias <> '' and coalesce(canonical_attraction_id, '') <> ''")
    last = rows.groupBy("park_id", "alias").agg(F.max_by(F.struct("canonical_attraction_id", "canonical_name", "category"), "_order").alias("x"))
    return last.select("park_id", "alias", F.col("x.canonical_attraction_id").alias("canonical_id"), "x.canonical_name", F.coalesce("x.category", F.lit("attraction")).alias("category"))


SCHEDULE = "schedule array<struct<date: string, type: string, openingTime: string, closingTime: string>>"


def schedules(documents: DataFrame, json_col: str = "json", park_col: str = "park_id", settings: Settings = Settings(), first_col: str | None = None) -> DataFrame:
    """(park_id, position, date, opens, closes, opening_time, closing_time) of usable entries; an absent date follows from the opening."""
    rows = _entities(documents, SCHEDULE, "schedule", json_col, park_col, first_col)
    opens, closes = F.try_to_timestamp("e.openingTime"), F.try_to_timestamp("e.closingTime")
    date = F.coalesce(F.nullif("e.date", F.lit("")), times.local_date(opens, settings.zone).cast("string"))
    out = rows.select("park_id", "position", date.alias("date"), opens.alias("opens"), closes.alias("closes"), F.col("e.openingTime").alias("opening_time"), F.col("e.closingTime").alias("closing_time"))
    return out.where("opens is not null and closes is not null")


RIDE = "struct<id: string, name: string, is_open: boolean, wait_time: double, last_updated: string>"
FEED = f"lands array<struct<name: string, rides: array<{RIDE}>>>, rides array<{RIDE}>"


def queue_feed(documents: DataFrame, json_col: str = "json", park_col: str = "park_id", first_land_col: str | None = None, first_ride_col: str | None = None) -> DataFrame:
    """(park_id, land, land_index, ride_index, ride_id, ride_name, is_open, wait, last_updated): rides of the lands, then those without one (land Other).

    A document that is a page of a park's feed has the number of its first land, and of the first ride of that land.
    """
    first = lambda c, as_: (F.col(c) if c else F.lit(0)).cast("int").alias(as_)
    parsed = documents.select(F.col(park_col).alias("park_id"), first(first_land_col, "l0"), first(first_ride_col, "r0"), F.from_json(json_col, FEED).alias("d"))
    lands = parsed.select("park_id", "l0", "r0", F.posexplode("d.lands").alias("k", "l")).select("park_id", F.col("l.name").alias("land"), (F.col("l0") + F.col("k")).alias("land_index"), F.when(F.col("k") == 0, F.col("r0")).otherwise(0).alias("r0"), F.posexplode("l.rides").alias("i", "r"))
    number = (F.col("l0") + F.greatest(F.lit(0), F.coalesce(F.size("d.lands"), F.lit(0)))).alias("land_index")
    rest = parsed.select("park_id", F.lit("Other").alias("land"), number, "r0", F.posexplode("d.rides").alias("i", "r"))
    fields = [F.col("r.id").alias("ride_id"), names.repaired(F.col("r.name")).alias("ride_name"), F.coalesce("r.is_open", F.lit(False)).alias("is_open"), F.col("r.wait_time").alias("wait"), F.col("r.last_updated").alias("last_updated")]
    return lands.unionByName(rest).select("park_id", names.repaired(F.col("land")).alias("land"), "land_index", (F.col("r0") + F.col("i")).alias("ride_index"), *fields)


_PLACE = "struct<latitude: string, lat: string, longitude: string, lng: string, lon: string>"
_SHOW = "struct<startTime: string, start: string, startDate: string, endTime: string, end: string, endDate: string>"
_ENTITY = f"""id: string, name: string, entityType: string, land: string, area: string, status: string, location: {_PLACE}, coordinates: {_PLACE},
    queue: map<string, struct<waitTime: double>>, waitTime: double, wait_time: double, showtimes: array<{_SHOW}>, showTimes: array<{_SHOW}>"""
ENTRIES = "schedule array<struct<id: string, entityId: string, date: string, openingTime: string, startTime: string, start: string, closingTime: string, endTime: string, end: string>>"


def _apart(schema: str) -> str:
    """The schema with a name of its own for the spelling that differs in a capital only, as columns are told apart without regard to case."""
    return schema.replace("showTimes:", "otherShows:").replace(" array<", ": array<", 1)


def _entities(documents: DataFrame, schema: str, what: str, json_col: str, park_col: str, first_col: str | None) -> DataFrame:
    """The records of documents, numbered as in the whole of a park's documents: a page of it says with which number it begins."""
    first = F.col(first_col) if first_col else F.lit(0)
    parsed = documents.select(F.col(park_col).alias("park_id"), first.cast("int").alias("first"), F.from_json(json_col, schema).cast(f"struct<{_apart(schema)}>").alias("d"))
    return parsed.select("park_id", "first", F.posexplode(f"d.{what}").alias("position", "e")).withColumn("position", F.col("first") + F.col("position"))


def _filled(*names: str):
    """The first of several fields that is neither absent nor empty."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def _entity() -> list:
    show = lambda s: F.struct(F.coalesce(s["startTime"], s["start"], s["startDate"]).alias("start"), F.coalesce(s["endTime"], s["end"], s["endDate"]).alias("end"))
    same = ["id", "name", "land", "area", "status", "location", "coordinates", "queue"]
    return [
        *[F.col(f"e.{c}").alias(c) for c in same], F.col("e.entityType").alias("entity_type"), F.col("e.waitTime").alias("wait_time"), F.col("e.wait_time").alias("other_wait"),
        F.transform("e.showtimes", show).alias("shows"), F.transform("e.otherShows", show).alias("other_shows"),
    ]


def children(documents: DataFrame, json_col: str = "json", park_col: str = "park_id", first_col: str | None = None) -> DataFrame:
    """The entities of catalogue documents, in order, with queues, waits and shows (start, end) of their own; what is no array has none."""
    return _entities(documents, f"children array<struct<{_ENTITY}>>", "children", json_col, park_col, first_col).select("park_id", "position", *_entity())


def live_entities(documents: DataFrame, json_col: str = "json", park_col: str = "park_id", first_col: str | None = None) -> DataFrame:
    """The entities of live documents, with the same columns."""
    return _entities(documents, f"liveData array<struct<{_ENTITY}>>", "liveData", json_col, park_col, first_col).select("park_id", "position", *_entity())


def schedule_entries(documents: DataFrame, json_col: str = "json", park_col: str = "park_id", first_col: str | None = None) -> DataFrame:
    """(park_id, position, id, date, opening, closing) of all entries of schedule documents, those of entities too."""
    rows = _entities(documents, ENTRIES, "schedule", json_col, park_col, first_col)
    return rows.select("park_id", "position", _filled("e.id", "e.entityId").alias("id"), F.col("e.date").alias("date"), _filled("e.openingTime", "e.startTime", "e.start").alias("opening"), _filled("e.closingTime", "e.endTime", "e.end").alias("closing"))


def first_available(*attempts: tuple[str, Callable[[], DataFrame]]) -> tuple[DataFrame, str]:
    """The first source that can be read, and its name; an error that names all of them if none can. Errors that don't come from reading go on to the caller."""
    failed = []
    for name, read in attempts:
        try:
            return read(), name
        except (PySparkException, Py4JJavaError, OSError, LookupError) as e:  # a source that is down or broken: the next one is asked
            failed.append(f"{name}: {e}")
    raise RuntimeError("no source could be read; " + "; ".join(failed))


def keep_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row by ``order`` of each key, with all columns: a maximum, which combines before the shuffle."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_last"))
    return last.select("_last.*")
