"""Items from catalogue entities, live data, schedules and queue feeds: waits, places and times of each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names, times
from tidemark.operators.items import category, estimated, is_open_state

#: The layout of an item, whichever feed it is from.
ITEM = ["park_id", "id", "name", "category", "entity_type", "land", "status", "is_open", "wait", "times", "lat", "lon", "location_source", "source", "is_single_rider"]


def wait_of(queue: Column, wait: Column, other: Column) -> Column:
    """The standby wait of a map of queues, else the entity's own in either spelling; null if none is a finite number."""
    standby = F.coalesce(F.try_element_at(queue, F.lit("STANDBY")), F.try_element_at(queue, F.lit("standby")))
    found = F.coalesce(standby["waitTime"], wait, other).cast("double")
    return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)


def _number(value: Column) -> Column:
    """A coordinate that may be a text; an empty one is 0, what is no finite number is null."""
    text = F.trim(value.cast("string"))
    found = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)


def place_of(location: Column, coordinates: Column) -> Column:
    """(lat, lon) of the first of two objects, in any of the spellings feeds use, as numbers or texts; null unless both are there."""
    o = F.coalesce(location, coordinates)
    lat, lon = _number(F.coalesce(o["latitude"], o["lat"])), _number(F.coalesce(o["longitude"], o["lng"], o["lon"]))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def range_text(start: Column, end: Column, zone: str) -> Column:
    """``start - end`` as clock texts; the start alone if there is no end or it reads the same; null without either."""
    begin, until = F.coalesce(times.clock_text(F.nullif(start, F.lit("")), zone), F.lit("")), times.clock_text(F.nullif(end, F.lit("")), zone)
    said = F.when(until.isNull() | (until == begin), begin).otherwise(F.concat(begin, F.lit(" - "), until))
    return F.nullif(said, F.lit(""))


def park_date(now: Column, zone: str) -> Column:
    """The date that it is in the park at an instant."""
    return times.local_date(now, zone)


def _on(value: Column, day: Column, zone: str) -> Column:
    return F.coalesce(times.local_date(F.try_to_timestamp(value), zone) == day, F.lit(False))


def show_times(shows: Column, hours: Column, today: Column, zone: str) -> Column:
    """Clock texts of the shows (start, end) that begin today within the park's hours, distinct, by minute. An end on another day is left out."""
    said = F.transform(F.coalesce(shows, F.array().cast("array<struct<start:string,end:string>>")), lambda s: F.when(_on(s["start"], today, zone), range_text(s["start"], F.when(_on(s["end"], today, zone), s["end"]), zone)))
    return times.sorted_times(F.filter(said, lambda t: t.isNotNull() & times.within_hours(t, hours)))


def schedule_times(entries: DataFrame, hours: DataFrame, zone: str) -> DataFrame:
    """(park_id, id, times) of the schedule's entries (park_id, id, date, opening, closing) that are of an entity and within the park's ``hours`` (park_id, hours).

    An entry without an opening begins with its date.
    """
    timed = entries.where("coalesce(id, '') <> ''").withColumn("t", range_text(F.coalesce("opening", "date"), F.col("closing"), zone)).where("t is not null")
    inside = timed.join(hours, "park_id", "left").where(times.within_hours(F.col("t"), F.col("hours")))
    return inside.groupBy("park_id", "id").agg(times.sorted_times(F.collect_set("t")).alias("times"))


def park_hours(entries: DataFrame, today: Column, zone: str, fallback: Column) -> DataFrame:
    """(park_id, hours): today's ranges of the entries without an entity; the fallback for parks that have none."""
    start = F.coalesce("opening", "date", F.lit(""))
    own = (F.coalesce("id", F.lit("")) == "") & (F.col("opening").isNotNull() | F.col("closing").isNotNull()) & ((start == "") | _on(start, today, zone))
    text = F.when(own, range_text(F.coalesce("opening", "date"), F.col("closing"), zone))
    found = entries.groupBy("park_id").agg(F.collect_set(text).alias("h"))
    return found.select("park_id", F.when(F.size("h") > 0, times.sorted_times(F.col("h"))).otherwise(times.sorted_times(fallback)).alias("hours"))


def with_place(items: DataFrame, curated: DataFrame, box: dict[str, Column], land: Column, ride: Column) -> DataFrame:
    """``items`` with lat, lon and location_source: their own place (``_place``), else the curated one of their display name, else one on a grid.

    Of curated rows (position, name, lat, lon) with one display name the first counts. Their size decides whether they are broadcast.
    """
    known = curated.groupBy(names.display_name(F.col("name")).alias("_key")).agg(F.min_by(F.struct("lat", "lon"), "position").alias("_curated"))
    lat, lon = estimated(box["north"], box["south"], box["west"], box["east"], land, ride)
    met = items.withColumn("_key", names.display_name(F.col("name"))).join(known, "_key", "left")
    best = F.coalesce("_place", "_curated")
    source = F.when(best.isNotNull(), "curated").otherwise("estimated")
    return met.withColumns({"lat": F.coalesce(best["lat"], lat), "lon": F.coalesce(best["lon"], lon), "location_source": source}).drop("_key", "_place", "_curated")


def entity_items(children: DataFrame, live: DataFrame, scheduled: DataFrame, curated: DataFrame, hours: DataFrame, box: dict[str, Column], today: Column, zone: str) -> DataFrame:
    """Items of the catalogue's entities that are attractions or entertainment, with live data by id where there is any.

    Each field that live data has goes before the same one of the catalogue, and only then is a land taken before an area, a queue
    before a wait, and one spelling before another: a land of the catalogue beats a live area. The last of several live rows of
    an id counts. A field that is null counts as absent. Entertainment has the times of its shows, else of the schedule.
    """
    fields = [c for c in live.columns if c not in ("park_id", "id", "position")]
    last = live.groupBy("park_id", "id").agg(F.max_by(F.struct(*fields), "position").alias("live"))
    met = children.join(last, ["park_id", "id"], "left").join(scheduled.withColumnRenamed("times", "_scheduled"), ["park_id", "id"], "left").join(hours, "park_id", "left")
    said = F.col("live")
    both = lambda c: F.coalesce(said[c], F.col(c))
    kind = F.coalesce(F.nullif("entity_type", F.lit("")), said["entity_type"], F.lit(""))
    none = F.array().cast("array<string>")
    shows = show_times(F.coalesce(both("shows"), both("other_shows")), F.col("hours"), today, zone)
    rows = met.select(
        "park_id", "id", "position", both("name").alias("name"), category(kind).alias("category"), kind.alias("entity_type"),
        F.coalesce(F.nullif(both("land"), F.lit("")), F.nullif(both("area"), F.lit("")), F.lit("Uncategorized")).alias("land"), F.coalesce(F.nullif(both("status"), F.lit("")), F.lit("UNKNOWN")).alias("status"),
        wait_of(both("queue"), both("wait_time"), both("other_wait")).alias("wait"), place_of(both("location"), both("coordinates")).alias("_place"), shows.alias("_shows"), "_scheduled",
    ).where("category is not null")
    timed = F.when(F.col("category") == "entertainment", F.when(F.size("_shows") > 0, F.col("_shows")).otherwise(F.coalesce("_scheduled", none))).otherwise(none)
    rows = rows.withColumns({"times": timed, "is_open": is_open_state(F.col("status")), "source": F.lit("catalog"), "is_single_rider": names.is_single_rider(F.col("name"))})
    return with_place(rows, curated, box, F.col("position"), F.lit(0)).select(*ITEM)


def queue_items(rides: DataFrame, curated: DataFrame, box: dict[str, Column]) -> DataFrame:
    """Items of a queue feed's rides (park_id, land, land_index, ride_index, ride_id, ride_name, is_open, wait)."""
    rows = rides.select(
        "park_id", F.concat(F.lit("queue-"), "park_id", F.lit("-"), "ride_id").alias("id"), F.col("ride_name").alias("name"), F.lit("attraction").alias("category"),
        F.lit("ATTRACTION").alias("entity_type"), "land", F.when(F.col("is_open"), "OPERATING").otherwise("CLOSED").alias("status"), "is_open", "wait",
        F.array().cast("array<string>").alias("times"), F.lit("queue").alias("source"), names.is_single_rider(F.col("ride_name")).alias("is_single_rider"), "land_index", "ride_index",
        F.lit(None).cast("struct<lat:double,lon:double>").alias("_place"),
    )
    return with_place(rows, curated, box, F.col("land_index"), F.col("ride_index")).select(*ITEM)


def all_parks(*parks: DataFrame) -> DataFrame:
    """The items of several parks as one table."""
    out = parks[0]
    for more in parks[1:]:
        out = out.unionByName(more)
    return out


def mappable(items: DataFrame) -> DataFrame:
    """Items whose place is known rather than estimated."""
    return items.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and location_source <> 'estimated'")


def hidden_from_map(items: DataFrame) -> DataFrame:
    """One row: how many items a map shows, and how many it doesn't."""
    shown = F.count_if(F.coalesce(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon") & (F.col("location_source") != "estimated"), F.lit(False)))
    return items.agg(shown.alias("shown"), (F.count(F.lit(1)) - shown).alias("hidden"))


def with_times(items: DataFrame) -> DataFrame:
    """The entertainment that has a time."""
    return items.where("category = 'entertainment' and size(times) > 0")


def column_titles(items: DataFrame) -> DataFrame:
    """(park_id, category, title): the number of items under each heading."""
    return items.groupBy("park_id", "category").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" items")).alias("title"))
