"""Feeds, caches, exports, settings, and checks of what was stored."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings, settings_from
from tidemark.operators import assembly, backfill, items
from tidemark.plans import publish
from tidemark.plans.versions import Published
from tidemark.sources import feeds


def test_settings():
    got = settings_from(["--stale-minutes=90", "--no-write", "--zone=UTC"], {"MIN_INTERVAL_MINUTES": "7"})
    assert got == Settings(stale_minutes=90, min_interval_minutes=7, zone="UTC")
    with pytest.raises(ValueError, match="stale_minutes"):
        settings_from(["--stale-minutes=soon"], {})


def test_fetch_and_read_through(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rides": []}')
    got = feeds.fetch(spark, [f"file://{tmp_path}/a.json"])
    assert [(r.url[-6:], r.json) for r in got.collect()] == [("a.json", '{"rides": []}')]
    cache, down = f"{tmp_path}/cache", lambda: feeds.fetch(spark, [f"file://{tmp_path}/gone.json"])
    assert [r.source for r in feeds.read_through(spark, lambda: got, cache).collect()] == ["live"]
    assert [(r.source, r.json) for r in feeds.read_through(spark, down, cache).collect()] == [("cache", '{"rides": []}')]
    sample = ("sample", lambda: spark.createDataFrame([("s", "{}")], "url string, json string"))
    assert [r.source for r in feeds.read_through(spark, down, f"{tmp_path}/none", sample).collect()] == ["sample"]
    with pytest.raises(RuntimeError):
        feeds.read_through(spark, down, f"{tmp_path}/none")


def test_export_keeps_other_dates(spark, tmp_path):
    rows = spark.createDataFrame([("2026-07-01", "a,b", None), ("2026-07-02", 'c"d', "x\ny")], "file_date string, name string, note string")
    publish.export_csv(rows, str(tmp_path), ["name", "note"])
    publish.export_csv(rows.where("name = 'a,b'").withColumn("note", F.lit("new")), str(tmp_path), ["name", "note"])
    texts = {p.name: p.read_bytes() for p in tmp_path.iterdir() if not p.name.startswith(".")}
    assert texts == {"wait_times_2026-07-01.csv": '﻿name,note\n"a,b",new\n'.encode(), "wait_times_2026-07-02.csv": '﻿name,note\n"c""d","x\ny"\n'.encode()}


def test_upload_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.csv").write_text("abc")
    whole = spark.read.format("binaryFile").load(f"{tmp_path}/in")
    for _ in range(2):
        row = publish.upload(whole, f"{tmp_path}/store/").collect()[0]
        assert open(row.object_uri.removeprefix("file://")).read() == "abc" and row.raw_archive_id in row.object_uri
    assert publish.assumed(whole, "s3://b/").first().object_uri == f"s3://b/wait-times/{row.raw_archive_id}/x.csv"


def test_upload_by_tasks(spark, tmp_path):
    """Many files over many tasks; a task that fails leaves no half files, and the upload can be repeated."""
    (tmp_path / "in").mkdir()
    for i in range(40):
        (tmp_path / f"in/f{i}.csv").write_text(f"text {i % 30}")
    whole = spark.read.format("binaryFile").load(f"{tmp_path}/in").repartition(8)
    lost = whole.withColumn("content", F.when(F.col("path").endswith("f7.csv"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception):
        publish.upload(lost, f"{tmp_path}/store")
    found = publish.upload(whole, f"file://{tmp_path}/store").collect()
    assert all(open(r.object_uri.removeprefix("file://")).read() == open(r.path.removeprefix("file:")).read() for r in found)
    assert len(found) == 40 and len(list((tmp_path / "store/wait-times").iterdir())) == 30
    # Of the failed run at most its own staging folder is left, by tasks that outlived it.
    assert [p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith("_staging-")] == ["wait-times"]
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "store/wait-times").rglob("*.csv")}
    publish.upload(whole, f"{tmp_path}/store")
    assert times == {p: p.stat().st_mtime_ns for p in (tmp_path / "store/wait-times").rglob("*.csv")}


def test_export_with_small_files(spark, tmp_path):
    rows = spark.range(100).select(F.lit("2026-07-01").alias("file_date"), F.col("id").cast("string").alias("n"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    try:
        publish.export_csv(rows, str(tmp_path), ["n"])
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len((tmp_path / "wait_times_2026-07-01.csv").read_text().splitlines()) == 101


def test_cache_survives_a_broken_feed(spark, tmp_path):
    cache = f"{tmp_path}/cache"
    good = spark.createDataFrame([("u", "{}")], "url string, json string")
    feeds.read_through(spark, lambda: good, cache)
    broken = good.withColumn("json", F.raise_error(F.lit("broken off")).cast("string"))
    assert [(r.source, r.json) for r in feeds.read_through(spark, lambda: broken, cache).collect()] == [("cache", "{}")]
    with pytest.raises(ZeroDivisionError):  # a bug isn't a feed that is down
        feeds.read_through(spark, lambda: 1 / 0, cache)


def test_cache_snapshot(spark, tmp_path):
    parks = spark.createDataFrame([("p", "Park", "1")], "park_id string, name string, entity_id string")
    listed = publish.manifest(parks, ["live"], "https://feeds.example", "cache")
    url = listed.first().url
    publish.cache_snapshot(spark.createDataFrame([(url, "{}")], "url string, json string"), listed, f"{tmp_path}/c")
    store = Published(spark, f"{tmp_path}/c")
    assert store.read("manifest").first().url == url and store.read("documents").first().json == "{}"
    with pytest.raises(RuntimeError, match="no answer"):
        publish.cache_snapshot(spark.createDataFrame([], "url string, json string"), listed, f"{tmp_path}/d")


def test_latest(spark):
    rows = spark.createDataFrame([("2026-07-01T00:00:00Z", "a"), ("2026-07-02T00:00:00Z", "b")], "snapshot_utc string, ride_id string")
    got = json.loads(publish.latest_snapshot(rows, []).first().json)
    assert got["rowCount"] == 1 and got["rows"][0]["ride_id"] == "b" and got["skippedParks"] == []
    assert publish.latest_report(spark.createDataFrame([("a", 1), ("b", 2)], "file_date string, n int")).first().n == 2


def test_changes_and_counts(spark):
    now = spark.createDataFrame([("x",)], "signature string")
    assert [items.changed(now, b).first().changed for b in (None, "x", "y")] == [False, False, True]
    counts = spark.createDataFrame([(3, 2)], "raw_count long, normalized_count long")
    backfill.require_stored(counts, 3, 2)
    with pytest.raises(ValueError, match="stored are 3"):
        backfill.require_stored(counts, 3, 3)
    backfill.require_sound(spark.createDataFrame([(0, 0)], "closed_with_wait long, invalid_timezones long"))
    with pytest.raises(ValueError, match="1 closed"):
        backfill.require_sound(spark.createDataFrame([(1, 0)], "closed_with_wait long, invalid_timezones long"))


def test_waits_and_places(spark):
    rows = spark.createDataFrame([({"standby": (7.0,)}, 1.0, None), (None, None, 5.0), ({"STANDBY": (None,)}, None, None), (None, float("nan"), None)], "q map<string, struct<waitTime: double>>, a double, b double")
    assert [r.w for r in rows.select(assembly.wait_of(F.col("q"), F.col("a"), F.col("b")).alias("w")).collect()] == [7.0, 5.0, None, None]
    place = "struct<latitude: double, lat: double, longitude: double, lng: double, lon: double>"
    rows = spark.createDataFrame([((1.0, None, None, 2.0, None), None), (None, (None, 3.0, None, None, 4.0)), ((1.0, None, None, None, None), None)], f"l {place}, c {place}")
    assert [r.p and tuple(r.p) for r in rows.select(assembly.place_of(F.col("l"), F.col("c")).alias("p")).collect()] == [(1.0, 2.0), (3.0, 4.0), None]
