"""Single functions: names, clocks, numbers, feeds, windows."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names, numbers, times
from tidemark.operators import items, windows
from tidemark.sources import files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("name", "same"),
    [("Soarin’ Across America", "soarin' across america"), ("Jones™Adventure", "jones tm adventure".replace(" tm ", " ")), ("Café & Más", "cafe and mas"), ("A  B — C", "a b - c"), ("ﬁsh \"x\"", "fish x"), ("", ""), (None, "")],
)
def test_catalog_name(spark, name, same):
    assert one(spark, names.catalog_name, name) == same


def test_names(spark):
    assert one(spark, names.base_name, "A Single Rider B") == "AB"
    assert one(spark, names.base_name, "Ride  single RIDER ") == "Ride"
    assert one(spark, names.is_single_rider, "Single Riders") is False
    assert one(spark, names.slug, "  Mickey's -- House! ") == "mickey-s-house"
    assert len(one(spark, names.slug, "x" * 200)) == 80 and one(spark, names.slug, "!!") == "unknown"
    assert one(spark, names.display_name, "“It’s” a  ™ Single Rider") == "its a"
    assert one(spark, names.is_entertainment, "The Parade!") is True and one(spark, names.is_entertainment, None) is False
    assert one(spark, names.repaired, "Soarin�?Across America") == "Soarin’ Across America"


def test_times(spark):
    assert one(spark, times.minute_of, "9:05 x") == 545 and one(spark, times.minute_of, "x") is None
    clock = lambda v: times.clock_text(v, "America/Los_Angeles")
    assert one(spark, clock, "2026-07-01T17:00:00Z") == "10:00" and one(spark, clock, "noonish") == "nooni"
    for at in ("2026-11-01T08:30:00Z", "2026-11-01T09:30:00Z"):  # the hour that the clock has twice
        assert one(spark, lambda v: times.local_text(F.to_timestamp(v), "America/Los_Angeles"), at) == "2026-11-01 01:30:00"
    inside = lambda span: lambda v: times.within_hours(v, F.array(F.lit(span)))
    for at, span, held in [("08:45", "09:00 - 17:00", False), ("17:45", "09:00 - 17:00", True), ("17:46", "09:00 - 17:00", False), ("00:30 - 01:00", "09:00 - 00:00", True), ("?", "09:00 - 17:00", True), ("12:00", "?", True)]:
        assert one(spark, inside(span), at) is held
    assert one(spark, times.sorted_times, ["10:00", "9:00", "10:00"], "array<string>") == ["9:00", "10:00"]


def test_numbers(spark):
    for text, value in [("", 0.0), (" ", 0.0), ("12", 12.0), ("12d", None), ("Infinity", None), ("-.5e1", -5.0)]:
        assert one(spark, numbers.lenient, text) == value
    assert one(spark, numbers.half_up, -2.5, "double") == -2.0
    assert one(spark, lambda v: numbers.strict(v, "n"), "") is None and one(spark, lambda v: numbers.strict_bool(v, "b"), "True") is True
    for column, bad in ((numbers.strict, "-1"), (numbers.strict, "x"), (numbers.strict_bool, "yes")):
        with pytest.raises(Exception, match="is n"):
            one(spark, lambda v: column(v, "field"), bad)


def test_feed(spark):
    feed = '{"lands": [{"name": "L", "rides": [{"id": 1, "name": "A", "is_open": true, "wait_time": 5}]}, {"name": "M"}], "rides": [{"id": "2", "name": "B", "is_open": false}]}'
    got = files.queue_feed(spark.createDataFrame([("p", feed), ("q", "{}"), ("r", None)], "park_id string, json string")).orderBy("ride_id").collect()
    assert [(r.land, r.ride_id, r.is_open, r.wait) for r in got] == [("L", "1", True, 5.0), ("Other", "2", False, None)]

    def down():
        raise OSError("503")

    assert files.first_available(("live", down), ("cache", lambda: "rows")) == ("rows", "cache")
    with pytest.raises(RuntimeError, match="503"):
        files.first_available(("live", down))


@pytest.mark.parametrize(("now", "inside"), [("2026-07-01 15:30:00", True), ("2026-07-01 15:29:59", False), ("2026-07-02 07:00:00", True), ("2026-07-02 07:00:01", False)])
def test_collecting(spark, now, inside):
    schedule = spark.sql("SELECT 'a' park_id, 0 position, '2026-07-01' date, timestamp'2026-07-01 16:00:00' opens, timestamp'2026-07-02 06:00:00' closes")
    got = windows.collecting(spark.sql(f"SELECT park_id, timestamp'{now}' at FROM VALUES ('a'), ('none') AS t(park_id)"), schedule).orderBy("park_id").collect()
    assert [r.should_collect for r in got] == [inside, False] and got[0].opens is not None and got[1].opens is None


def test_items(spark):
    rows = spark.createDataFrame([(1, "Ride", False, "OPEN", 5, 1), (2, "Ride Single Rider", True, "DOWN", 9, 2), (3, "Gone Single Rider", True, "OPEN", 1, 3)], "id int, name string, is_single_rider boolean, status string, wait int, position int")
    assert [(r.id, r.single_rider_status, r.single_rider_wait) for r in items.attach_single_rider(rows).collect()] == [(1, "DOWN", 9)]
    none = rows.limit(0).select("wait").withColumns({"is_open": F.lit(True), "category": F.lit("attraction")})
    k = items.kpis(none).first()
    assert (k.open_count, k.average_wait, k.max_wait) == (0, 0, "N/A")
    assert one(spark, items.category, "RESTAURANT") is None and one(spark, items.is_open_state, "operating") is True
    empty = windows.throttled(spark.sql("SELECT timestamp'2024-01-01' snapshot_ts").limit(0), F.lit("2024-01-01").cast("timestamp")).first()
    assert empty.latest is None and empty.skip is False
