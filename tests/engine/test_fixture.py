"""The nine-row fixture through the whole analysis: files, aliases, schedule, cleaning, resolving, report."""

import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import lineage, quality
from tidemark.plans.analyze import analyze, markdown, page, publish, report, write
from tidemark.sources import files
from tidemark.streaming.collect import collect

DAY = "2026-07-01T"
RIDES = [
    ("standby-stale", "dca", "Soarin' Across America", "TRUE", "55", "17:00", "15:00"),
    ("standby-fresh", "dca", "Soarin' Over California", "TRUE", "25", "17:00", "16:55"),
    ("sr-zero", "dca", "Soarin' Across America Single Rider", "TRUE", "0", "17:00", "16:58"),
    ("sr-positive", "dca", "Soarin' Across America Single Rider", "TRUE", "15", "17:05", "17:04"),
    ("closed-ride", "disneyland", "Space Mountain", "FALSE", "0", "17:00", "16:59"),
    ("open-zero", "disneyland", "Mad Tea Party", "TRUE", "0", "17:00", "16:59"),
    ("missing-wait", "disneyland", "Indiana Jones Adventure", "TRUE", "", "17:00", "16:59"),
    ("mickey-a", "disneyland", "Mickey's House and Meet Mickey Mouse", "TRUE", "10", "17:00", "16:58"),
    ("mickey-b", "disneyland", "Mickey's House and Meet Mickey Mouse", "TRUE", "12", "17:00", "16:59"),
]
ALIASES = [
    ("dca", "Soarin' Over California", "dca-soarin", "Soarin'", "attraction", ""),
    ("dca", "Soarin' Across America", "dca-soarin", "Soarin'", "attraction", ""),
    ("dca", "Soarin’ Across America", "dca-soarin", "Soarin'", "attraction", "curly"),
    ("disneyland", "Mickey's House and Meet Mickey Mouse", "disneyland-mickeys-house-and-meet-mickey-mouse", "Mickey's House", "entertainment", ""),
    ("", "no park", "x", "x", "attraction", ""),
]
SCHEDULE = '{"schedule": [{"date": "2026-07-01", "openingTime": "2026-07-01T16:00:00Z", "closingTime": "2026-07-02T06:00:00Z"}, {"date": "2026-07-02", "openingTime": "bad"}]}'


def csv_text():
    lines = [",".join(files.RAW_COLUMNS)]
    for ride, park, name, is_open, wait, at, source in RIDES:
        cells = [f"{DAY}{at}:00Z", "", "2026-07-01", "America/Los_Angeles", park, park, "Land, \"East\"", ride, name, is_open, wait, f"{DAY}{source}:00Z", "", "fixture://feed"]
        lines.append(",".join('"' + c.replace('"', '""') + '"' if '"' in c or "," in c else c for c in cells))
    return "﻿" + "\n".join([*lines, "," * 13]) + "\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("daily")
    (path / "wait_times_2026-07-01.csv").write_text(csv_text(), encoding="utf-8")
    (path / "other.csv").write_text("a\n1\n")
    return path


@pytest.fixture(scope="module")
def raw(spark, folder):
    return files.raw_observations(spark, str(folder))


@pytest.fixture(scope="module")
def found(spark, raw):
    aliases = files.aliases(spark.createDataFrame(ALIASES, files.ALIAS_COLUMNS))
    schedule = files.schedules(spark.createDataFrame([("dca", SCHEDULE), ("disneyland", SCHEDULE)], "park_id string, json string"))
    return analyze(files.typed(raw), aliases, schedule)


def test_files(spark, folder, raw):
    assert [(r.file_date) for r in files.observation_files(spark, str(folder)).collect()] == ["2026-07-01"]
    assert raw.count() == 9 and raw.first().land == 'Land, "East"'
    filled = files.with_legacy_defaults(raw).first()
    assert filled.snapshot_park_datetime == "2026-07-01 10:00:00" and filled.source_last_updated_park_datetime == "2026-07-01 08:00:00"


def test_cleaned(found):
    rows = {r.ride_id: r for r in found.cleaned.collect()}
    got = {k: (r.canonical_id, r.match_source, r.access_mode, r.age_tenths, r.observed_wait, "|".join(r.quality_flags), r.training_eligibility) for k, r in rows.items()}
    assert got == {
        "standby-stale": ("dca-soarin", "alias_exact", "standby", 1200, 55.0, "stale_source", "exclude_stale_source"),
        "standby-fresh": ("dca-soarin", "alias_exact", "standby", 50, 25.0, "", "standby_wait_model"),
        "sr-zero": ("dca-soarin", "alias_base", "single_rider", 20, 0.0, "open_zero|single_rider", "single_rider_optimizer_reference"),
        "sr-positive": ("dca-soarin", "alias_base", "single_rider", 10, 15.0, "single_rider", "single_rider_optimizer_reference"),
        "closed-ride": ("disneyland-space-mountain", "auto_normalized", "standby", 10, None, "closed|possible_full_day_closed", "status_model_only"),
        "open-zero": ("disneyland-mad-tea-party", "auto_normalized", "standby", 10, 0.0, "open_zero", "standby_wait_model"),
        "missing-wait": ("disneyland-indiana-jones-adventure", "auto_normalized", "standby", 10, 0.0, "open_zero", "standby_wait_model"),
        "mickey-a": ("disneyland-mickeys-house-and-meet-mickey-mouse", "alias_exact", "standby", 20, 10.0, "", "standby_wait_model"),
        "mickey-b": ("disneyland-mickeys-house-and-meet-mickey-mouse", "alias_exact", "standby", 10, 12.0, "", "standby_wait_model"),
    }


def test_ready(found):
    got = [(str(r.snapshot_ts)[11:16], r.park_id, r.access_mode, r.ride_id, r.wait_weight, r.candidate_count, r.resolver_reason) for r in found.ready.orderBy("snapshot_ts", "park_id", "canonical_id", "access_mode").collect()]
    one, two = "single_candidate", "selected_best_non_stale_candidate"
    assert got == [
        ("17:00", "dca", "single_rider", "sr-zero", 0.0, 1, one), ("17:00", "dca", "standby", "standby-fresh", 25.0, 2, two),
        ("17:00", "disneyland", "standby", "missing-wait", 0.0, 1, one), ("17:00", "disneyland", "standby", "open-zero", 0.0, 1, one),
        ("17:00", "disneyland", "standby", "mickey-b", 12.0, 2, two), ("17:00", "disneyland", "standby", "closed-ride", None, 1, one),
        ("17:05", "dca", "single_rider", "sr-positive", 15.0, 1, one),
    ]


def test_report(found, tmp_path):
    row = report(found).first()
    s = row.summary
    assert (s.total_rows, s.snapshots, s.rides, s.canonical_attractions, s.closed_rows, s.zero_wait_rows, s.open_zero_rows, s.stale_rows) == (9, 2, 9, 5, 1, 4, 3, 1)
    assert (s.single_rider_rows, s.entertainment_rows, s.standby_model_rows, s.status_only_rows) == (2, 0, 5, 1)
    assert (row.optimizer.ready_rows, row.optimizer.conflict_resolved_rows, row.optimizer.stale_selected_rows) == (7, 2, 0)
    assert (row.single_rider.groups, row.single_rider.usable_groups, row.full_day_closed, row.downtime, row.stale_sources) == (1, 1, 1, 0, 1)
    assert (row.missing_snapshots, row.unexpected_snapshots) == (1, 0) and len(row.recommendations) == 4
    text = markdown(row)
    assert "| dca | 4 |" in text and "- Total rows: 9" in text
    assert (row.duplicate_groups, row.conflict_groups) == (1, 2) and "- Duplicate groups: 1" in text
    doubled = quality.duplicate_groups(found.cleaned).collect()
    assert [[x.ride_id for x in g.records] for g in doubled] == [["mickey-a", "mickey-b"]]
    conflicts = quality.conflict_groups(found.cleaned).collect()
    assert sorted([x.ride_id for x in g.records] for g in conflicts) == [["mickey-a", "mickey-b"], ["standby-stale", "standby-fresh"]]
    write(found, str(tmp_path / "out"))
    assert (tmp_path / "out" / "cleaned" / "file_date=2026-07-01").exists()
    write(found, str(tmp_path / "none"), dry_run=True)
    assert not (tmp_path / "none").exists()


def test_page(found):
    text = page(found, "2026-07-01")
    assert "| dca | Soarin' Across America | 2 | 2 | 1 | 1 | use_wait_reference |" in text
    assert "## Possible full-day closed rides" in text and "| disneyland | Space Mountain | 1 | 1 | 1.0 |" in text
    assert "## Stale sources" in text and "## Temporary" not in text and "| 2026-07-01 17:05:00 | disneyland | missing |" in text
    assert "more are not shown" not in text and "more are not shown" not in page(found, "2026-07-01", 1)
    with pytest.raises(LookupError):
        page(found, "2026-07-02")


def test_publish(found, raw, tmp_path):
    store = publish(found, f"{tmp_path}/s")
    assert store.read("cleaned").count() == 9 and store.read("report").first().summary.total_rows == 9
    later = analyze(files.typed(raw.withColumn("file_date", F.lit("2026-07-02")).limit(4)))
    publish(later, f"{tmp_path}/s")
    assert {(r.file_date, r["count"]) for r in store.read("cleaned").groupBy("file_date").count().collect()} == {("2026-07-01", 9), ("2026-07-02", 4)}


def test_large_groups_in_chunks(found, monkeypatch):
    monkeypatch.setattr(quality, "LISTED", 2)
    rows = found.cleaned.sparkSession.range(7).select(F.lit("d").alias("file_date"), F.lit("s").alias("snapshot_ts"), F.when(F.col("id") < 5, "p").otherwise("q").alias("park_id"), F.lit("n").alias("name"), (F.col("id") * 5000).alias("src_row"), F.col("id").alias("ride_id"), F.lit("x").alias("ride_name"), F.lit(True).alias("is_open"), F.lit(1.0).alias("wait"))
    got = {(r.park_id, r.row_count, r.chunk): [x.ride_id for x in r.records] for r in quality.duplicate_groups(rows).collect()}
    assert got == {("p", 5, 0): [0, 1], ("p", 5, 1): [2, 3], ("p", 5, 2): [4], ("q", 2, 0): [5, 6]}


def test_distinct_counts_without_expand(found):
    plan = quality.summary(found.cleaned)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_settings(raw):
    half = analyze(files.typed(raw, Settings(blank_as_zero=False)), settings=Settings(stale_minutes=120, blank_as_zero=False))
    rows = {r.ride_id: r for r in half.cleaned.collect()}
    assert rows["missing-wait"].training_eligibility == "exclude_missing_wait"
    assert "stale_source" not in rows["standby-stale"].quality_flags  # an age of exactly the threshold isn't stale


def test_lineage(spark, folder, raw, found):
    archive = lineage.archives(spark.read.format("binaryFile").load(str(folder / "wait_times_2026-07-01.csv"))).first()
    assert len(archive.raw_archive_id) == 64 and archive.source_name == "wait_times_2026-07-01.csv"
    assert lineage.problems(raw).count() == 0 and lineage.require_valid(raw) is raw
    with pytest.raises(ValueError, match="ride_id"):
        lineage.require_valid(raw.withColumn("ride_id", F.lit("")))
    records = lineage.raw_records(raw, F.lit(archive.raw_archive_id), F.col("src_row"))
    normal = lineage.normalized_ids(lineage.matched(found.cleaned, records))
    assert normal.where("raw_observation_id is null").count() == 0
    assert normal.select("normalized_observation_id").distinct().count() == 9
    broken = lineage.violations(normal).first()
    assert (broken.closed_with_wait, broken.negative_age, broken.unknown_mode, broken.single_rider) == (0, 0, 0, 2)
    assert lineage.standby_analysis(normal).count() == 5
    uri = spark.range(1).select(lineage.object_uri(F.lit("s3://bucket/"), F.lit("abc"), F.lit("f.csv")).alias("u")).first().u
    assert uri == "s3://bucket/wait-times/abc/f.csv"
    with pytest.raises(Exception, match="not an object store"):
        spark.range(1).select(lineage.object_uri(F.lit("ftp://x"), F.lit("a"), F.lit("f"))).collect()


def test_stream_replay(spark, folder, tmp_path):
    landed, target = tmp_path / "in", str(tmp_path / "out")
    landed.mkdir()
    (landed / "a.csv").write_text((folder / "wait_times_2026-07-01.csv").read_text(encoding="utf-8-sig"))
    collect(spark, str(landed), target, str(tmp_path / "cp")).awaitTermination()
    first = spark.read.parquet(target).count()
    (landed / "b.csv").write_text((landed / "a.csv").read_text())
    collect(spark, str(landed), target, str(tmp_path / "cp")).awaitTermination()
    assert first == spark.read.parquet(target).count() >= 9
