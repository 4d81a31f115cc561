"""Instants, zones, wall clocks and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import SHOW_CLOSE_BUFFER_MINUTES, SHOW_OPEN_BUFFER_MINUTES


def millis(instant: Column) -> Column:
    return F.floor(F.unix_micros(instant.cast("timestamp")) / 1000)


def local_text(instant: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd HH:mm:ss")


def local_date(instant: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def clock_text(value: Column, zone: str) -> Column:
    """HH:mm in the zone; what is no instant keeps its first five characters."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.try_to_timestamp(value), zone), "HH:mm"), F.left(value, F.lit(5)))


def minute_of(clock: Column) -> Column:
    """Minutes since midnight of a text that begins with h:mm, else null."""
    part = lambda g: F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})", g).try_cast("int")
    return part(1) * 60 + part(2)


def age_millis(snapshot: Column, source: Column) -> Column:
    return millis(snapshot) - millis(source)


def age_tenths(age: Column) -> Column:
    """Tenths of minutes, half up, from milliseconds."""
    return F.floor((age + 3000) / 6000)


def within_hours(time: Column, hours: Column, before: int = SHOW_OPEN_BUFFER_MINUTES, after: int = SHOW_CLOSE_BUFFER_MINUTES) -> Column:
    """Whether a clock text lies in any of the ranges ``start - end``; unreadable texts and no ranges count as inside."""
    start = minute_of(F.split_part(time, F.lit(" - "), F.lit(1)))

    def holds(span: Column) -> Column:
        opens, closes = minute_of(F.split_part(span, F.lit(" - "), F.lit(1))), minute_of(F.split_part(span, F.lit(" - "), F.lit(2)))
        ends = F.when((closes == 0) | (closes < opens), closes + 1440).otherwise(closes)
        at = F.when(start < opens, start + 1440).otherwise(start)
        return F.coalesce((at >= opens - before) & (at <= ends + after), F.lit(True))

    return F.when(start.isNull() | (F.coalesce(F.size(hours), F.lit(0)) <= 0), F.lit(True)).otherwise(F.exists(hours, holds))


def sorted_times(times: Column) -> Column:
    """Distinct clock texts by minute, those of one minute by text."""
    keyed = F.transform(F.array_distinct(times), lambda t: F.struct(F.coalesce(minute_of(t), F.lit(0)).alias("m"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])
