"""Opening hours against observations: collection windows, their gaps, the nearest entry, the minimum interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import CLOSE_BUFFER_MINUTES, OPEN_BUFFER_MINUTES, Settings
from tidemark.operators.ordered import Ordered

#: Days on either side of an instant within which the windows that contain it open: entries of that day and its neighbours.
NEIGHBOUR_DAYS = 1
#: Parks that the gaps of one table are worked out for.
MOST_PARKS = 10_000


def _inside(at: Column, opens: Column, closes: Column, before: float, after: float) -> Column:
    us = lambda c: F.unix_micros(c)
    return (us(at) >= us(opens) - int(before * 60_000_000)) & (us(at) <= us(closes) + int(after * 60_000_000))


def collection_gaps(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """Each snapshot of a file date with each park: expected by the schedule of that date, and whether rows are there.

    The first entry for the park and date decides; without one, rows are expected. The parks are those of the schedule and
    of the rows, ``MOST_PARKS`` at most (more are an error): one list of them is put on each snapshot.
    """
    there = rows.select("file_date", "snapshot_ts", "park_id").distinct()
    parks = schedule.select("park_id").unionByName(there.select("park_id")).where("park_id is not null").distinct()
    entry = schedule.groupBy("park_id", F.col("date").alias("file_date")).agg(F.min_by(F.struct("opens", "closes"), "position").alias("e"))
    listed = F.sort_array(F.collect_list("park_id"))
    too_many = F.raise_error(F.lit(f"more than {MOST_PARKS} parks")).cast("array<string>")
    listed = parks.limit(MOST_PARKS + 1).agg(F.when(F.count(F.lit(1)) > MOST_PARKS, too_many).otherwise(listed).alias("parks"))
    snapshots = there.select("file_date", "snapshot_ts").distinct()
    checks = snapshots.withColumn("park_id", F.explode(listed.scalar()))
    present = there.withColumn("rows_present", F.lit(True))
    out = checks.join(entry, ["park_id", "file_date"], "left").join(present, ["file_date", "snapshot_ts", "park_id"], "left")
    expected = F.when(F.col("e").isNull(), True).otherwise(_inside(F.col("snapshot_ts"), F.col("e.opens"), F.col("e.closes"), OPEN_BUFFER_MINUTES, CLOSE_BUFFER_MINUTES))
    rows_present = F.coalesce("rows_present", F.lit(False))
    state = F.when(expected & ~rows_present, "missing").when(~expected & rows_present, "unexpected").otherwise("as_expected")
    return out.select("file_date", "snapshot_ts", "park_id", expected.alias("expected"), rows_present.alias("rows_present"), state.alias("state"), "e.opens", "e.closes")


def collecting(instants: DataFrame, schedule: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``instants`` (park_id, at, ...) with should_collect, reason and the opening hours that contain or are nearest to each.

    Of several that contain it, the earliest opening; of several nearest, the earliest position. The interval join has the
    day of the opening in its key: an entry is put on its own day and the days that its window and buffers reach.
    """
    day = lambda c: F.to_date(c)
    before, after = settings.open_buffer_minutes, settings.close_buffer_minutes
    reach = schedule.withColumn("day", F.explode(F.sequence(F.date_sub(day(F.col("opens")), NEIGHBOUR_DAYS + int(before // 1440)), F.date_add(day(F.col("closes")), NEIGHBOUR_DAYS + int(after // 1440)))))
    # One row for each park and instant, however many of the given rows have it.
    keys = ["park_id", "at"]
    asked = instants.select(*keys).distinct().withColumn("day", day(F.col("at")))
    hours = F.struct("opens", "closes")
    inside = F.when(_inside(F.col("at"), F.col("opens"), F.col("closes"), before, after), F.struct(F.col("opens").alias("k"), "position", hours.alias("h")))
    held = asked.join(reach, ["park_id", "day"], "left").groupBy(*keys).agg(F.min(inside).alias("w"))
    far = nearest(held.where("w is null").select(*keys), schedule)
    told = held.join(far, keys, "left").select(*keys, F.col("w").isNotNull().alias("should_collect"), F.coalesce("w.h", "hours").alias("hours"))
    out = instants.join(told, keys, "left").withColumn("should_collect", F.coalesce("should_collect", F.lit(False)))
    reason = F.when(F.col("should_collect"), "inside park hours collection window").otherwise("outside park hours collection window")
    return out.select(*instants.columns, "should_collect", reason.alias("reason"), F.col("hours.opens").alias("opens"), F.col("hours.closes").alias("closes"))


def nearest(instants: DataFrame, schedule: DataFrame) -> DataFrame:
    """(park_id, at, hours): the entry of the park that opens nearest to each instant; of several as near, the first by position.

    Entries and instants stand in one order of time, spread over range partitions, and each instant takes the last opening
    before and the first one after it: linear in both, where a join would pair all of a park's, and no park is one task's.
    """
    opens = schedule.where("opens is not null").groupBy("park_id", F.col("opens").alias("at")).agg(F.min_by(F.struct("position", F.struct("opens", "closes").alias("h")), "position").alias("e"))
    both = instants.select("park_id", "at", F.lit(None).cast(opens.schema["e"].dataType).alias("e"), F.lit(True).alias("asks"))
    both = both.unionByName(opens.withColumn("asks", F.lit(False)))
    placed = Ordered(both, ["park_id"], ["at", "asks"]).last("last", F.col("e")).following("after", F.col("e"))
    met = placed.frame().where("asks")
    apart = lambda e: F.abs(F.unix_micros(F.col(f"{e}.h.opens")) - F.unix_micros("at"))
    best = F.least(*[F.when(F.col(e).isNotNull(), F.struct(apart(e).alias("k"), F.col(f"{e}.position").alias("position"), F.col(f"{e}.h").alias("h"))) for e in ("last", "after")])
    return met.select("park_id", "at", best["h"].alias("hours"))


def throttled(rows: DataFrame, now: Column, settings: Settings = Settings()) -> DataFrame:
    """One row: the latest snapshot and whether the next one has to wait. No rows: null, and nothing to wait for."""
    late = F.max("snapshot_ts")
    soon = F.unix_micros(now) - F.unix_micros(late) < int(settings.min_interval_minutes * 60_000_000)
    return rows.agg(late.alias("latest"), F.coalesce(soon, F.lit(False)).alias("skip"))
