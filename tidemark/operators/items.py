"""Catalogue, live data and queue feeds as one table of items, and what a view of it shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import base_name, display_name
from tidemark.functions.numbers import clamp, half_up

# Entity types that are entertainment, and states that are open.
ENTERTAINMENT_TYPES = ["SHOW", "ENTERTAINMENT", "PARADE", "NIGHTTIME_SPECTACULAR", "CHARACTER"]
OPEN_STATES = ["OPERATING", "OPEN", "SCHEDULED"]
PADDING, LEAST_PADDING = 0.08, 0.0008
GRID = 5


def category(entity_type: Column) -> Column:
    return F.when(entity_type == "ATTRACTION", "attraction").when(entity_type.isin(ENTERTAINMENT_TYPES), "entertainment")


def is_open_state(status: Column) -> Column:
    return F.coalesce(F.upper(status).isin(OPEN_STATES), F.lit(False))


def merge_feeds(catalog: DataFrame, queue: DataFrame, mark: str = " + queue feed") -> DataFrame:
    """Items of the catalogue with state and wait of the queue feed, by display name, and the queue's other items.

    Both have (id, name, land, wait, is_open, status, source) and the queue ``position``. Of queue items with one name the
    last counts; those without a catalogue item all stay. A land of Uncategorized is replaced.
    """
    catalog, queue = catalog.withColumn("key", display_name(F.col("name"))), queue.withColumn("key", display_name(F.col("name")))
    last = queue.groupBy("key").agg(F.max_by(F.struct("land", "wait", "is_open", "status"), "position").alias("q"))
    met, q = catalog.join(last, "key", "left"), F.col("q")
    pick = lambda c: F.when(q.isNotNull(), q[c]).otherwise(F.col(c)).alias(c)
    land = F.when(q.isNotNull() & (F.col("land") == "Uncategorized"), q["land"]).otherwise(F.col("land")).alias("land")
    source = F.when(q.isNotNull(), F.concat("source", F.lit(mark))).otherwise(F.col("source")).alias("source")
    merged = met.select("id", "name", land, pick("wait"), pick("is_open"), pick("status"), source)
    alone = queue.join(catalog.select("key").distinct(), "key", "left_anti")
    return merged.unionByName(alone.select(*merged.columns))


def add_missing(items: DataFrame, more: DataFrame, name_col: str = "name") -> DataFrame:
    """``items`` and those of ``more`` whose display name none of them has."""
    known = items.select(display_name(F.col(name_col)).alias("_key")).distinct()
    return items.unionByName(more.withColumn("_key", display_name(F.col(name_col))).join(known, "_key", "left_anti").drop("_key"))


def attach_single_rider(items: DataFrame) -> DataFrame:
    """Single-rider entries (is_single_rider) become columns of their base item; entries without one are left out."""
    entry = items.where("is_single_rider").withColumn("key", display_name(base_name(F.col("name"))))
    last = entry.groupBy("key").agg(F.max_by(F.struct("status", "wait"), "position").alias("s"))
    base = items.where("not is_single_rider").withColumn("key", display_name(F.col("name"))).join(last, "key", "left")
    return base.withColumns({"has_single_rider": F.col("s").isNotNull(), "single_rider_status": F.col("s.status"), "single_rider_wait": F.col("s.wait")}).drop("s", "key")


def view(items: DataFrame, park: str = "all", kind: str = "all", status: str = "all", search: str = "") -> DataFrame:
    """The items that a view shows, in no order."""
    if park != "all":
        items = items.where(F.col("park_id") == park)
    if kind != "all":
        items = items.where(F.col("category") == kind)
    if status in ("open", "closed"):
        items = items.where(F.col("is_open") == (status == "open"))
    if text := search.strip().lower():
        items = items.where(F.lower("name").contains(text) | F.lower("land").contains(text))
    return items


def in_order(items: DataFrame) -> DataFrame:
    return items.orderBy("park_id", "category", F.coalesce("wait", F.lit(0)).desc(), "name", "id")


def kpis(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Open attractions, their mean wait rounded half up (0 for none) and the highest ("N/A" for none or 0)."""
    open_ = F.col("is_open") & (F.col("category") == "attraction")
    wait = F.when(open_, F.col("wait"))
    high = F.max(wait)
    return items.groupBy(*(by or [])).agg(
        F.count_if(open_).alias("open_count"), F.coalesce(half_up(F.avg(wait)), F.lit(0)).cast("long").alias("average_wait"), F.when(high > 0, high.cast("long").cast("string")).otherwise("N/A").alias("max_wait")
    )


def signature(items: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """One row: a hash that tells whether the rows' fields are the same as before; nulls and empty texts count as equal. Rows are hashed before they are gathered:
    per first four digits of the row's hash, then over those 65,536 at most, so that no task sorts the whole table's contents."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [key, *fields]])
    hashed = items.select(F.sha2(text.cast("binary"), 256).alias("h"))
    buckets = hashed.groupBy(F.left("h", F.lit(4)).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ",").cast("binary"), 256).alias("h"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ",").cast("binary"), 256).alias("signature"))


def changed(now: DataFrame, before: str | None) -> DataFrame:
    """One row: the signature and whether it differs from a stored one; without one nothing has changed."""
    return now.withColumn("changed", F.lit(before is not None) & (F.col("signature") != F.coalesce(F.lit(before), F.lit(""))))


def estimated(north: Column, south: Column, west: Column, east: Column, land: Column, ride: Column) -> list[Column]:
    """A place on a grid over the bounds for what has no coordinates."""
    col, row = (land + ride) % GRID, (land * 2 + ride) % GRID
    return [(north - (north - south) * ((row + 0.5) / GRID)).alias("lat"), (west + (east - west) * ((col + 0.5) / GRID)).alias("lon")]


def bounds(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Padded bounding box of the items."""
    box = items.groupBy(*(by or [])).agg(F.max("lat").alias("n"), F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    lat, lon = F.greatest((F.col("n") - F.col("s")) * PADDING, F.lit(LEAST_PADDING)), F.greatest((F.col("e") - F.col("w")) * PADDING, F.lit(LEAST_PADDING))
    return box.select(*(by or []), (F.col("n") + lat).alias("north"), (F.col("s") - lat).alias("south"), (F.col("w") - lon).alias("west"), (F.col("e") + lon).alias("east"))


def projected(lat: Column, lon: Column, box: dict[str, Column]) -> list[Column]:
    """Percent from the left and the top of a map of the box, kept off its edges."""
    x = (lon - box["west"]) / (box["east"] - box["west"]) * 100
    y = (box["north"] - lat) / (box["north"] - box["south"]) * 100
    return [clamp(x, 3.0, 97.0).alias("x"), clamp(y, 3.0, 97.0).alias("y")]


def content_signature(columns: list[str]) -> dict[str, Column]:
    """Aggregates (n, x, s) that are the same for the same rows in whatever order: their number, the exclusive or and the sum of 60 bits of a hash of each.

    They merge by adding, exclusive or and adding, so parts can be hashed where they are; nothing is sorted or gathered.
    """
    said = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    h = F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return {"n": F.count(F.lit(1)), "x": F.bit_xor(h), "s": F.sum(h.cast("decimal(38,0)"))}


def merged_signature() -> dict[str, Column]:
    """Aggregates over signatures of parts: the signature of all their rows."""
    return {"n": F.sum("n"), "x": F.bit_xor("x"), "s": F.sum("s").cast("decimal(38,0)")}
