"""The stream over several batches and restarts: minimum interval, gate, unchanged snapshots, broken runs."""

import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import items
from tidemark.plans.versions import Published
from tidemark.sources.files import RAW_COLUMNS
from tidemark.streaming import collect as stream


class Feed:
    def __init__(self, spark, tmp_path):
        self.spark, self.landed, self.target, self.checkpoint = spark, tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/cp"
        self.landed.mkdir()

    def land(self, name, *rows):
        """rows: (time, park, ride, wait)"""
        lines = [",".join(RAW_COLUMNS)]
        lines += [f"2026-07-01T{t}:00Z,,2026-07-01,America/Los_Angeles,{park},P,L,{ride},Ride {ride},True,{wait},2026-07-01T{t}:00Z,,u" for t, park, ride, wait in rows]
        (self.landed / f"{name}.csv").write_text("\n".join(lines) + "\n")

    def run(self, **options):
        stream.collect(self.spark, str(self.landed), self.target, self.checkpoint, **options).awaitTermination()

    def stored(self):
        try:
            rows = self.spark.read.parquet(self.target)
        except Exception:
            return []
        return sorted((r.t, r.park_id, r.ride_id) for r in rows.select(F.substring("snapshot_utc", 12, 5).alias("t"), "park_id", "ride_id").collect())


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_minimum_interval_over_restarts(feed):
    feed.land("a", ("17:00", "p", "1", 5), ("17:00", "p", "2", 5))
    feed.run()
    feed.land("b", ("17:03", "p", "1", 6))
    feed.land("c", ("17:00", "q", "3", 5))  # late, of a snapshot that is kept
    feed.run()
    assert feed.stored() == [("17:00", "p", "1"), ("17:00", "p", "2"), ("17:00", "q", "3")]
    feed.land("d", ("17:05", "p", "1", 7), ("17:09", "p", "1", 8), ("17:12", "p", "1", 9))
    feed.run()
    assert [t for t, p, r in feed.stored() if r == "1"] == ["17:00", "17:05", "17:12"]
    feed.land("e", ("17:13", "p", "1", 7))
    feed.run(settings=Settings(min_interval_minutes=0))
    assert [t for t, p, r in feed.stored() if r == "1"] == ["17:00", "17:05", "17:12", "17:13"]


def test_a_repeated_batch_adds_what_is_missing(feed, monkeypatch):
    """Broken off after the rows and before the state: the batch runs again, and nothing is lost or doubled."""
    feed.land("a", ("17:00", "p", "1", 5), ("17:02", "p", "1", 6))
    publish = Published.publish
    monkeypatch.setattr(Published, "publish", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception):
        feed.run()
    assert feed.stored() == [("17:00", "p", "1")]
    monkeypatch.setattr(Published, "publish", publish)
    feed.run()
    assert feed.stored() == [("17:00", "p", "1")]


def test_gate_with_a_schedule_read_for_each_batch(feed, spark):
    hours = {"p": ("2026-07-01 16:00:00", "2026-07-01 23:00:00"), "q": ("2026-07-01 20:00:00", "2026-07-01 23:00:00")}
    asked = []

    def schedule():
        asked.append(1)
        rows = [(p, 0, "2026-07-01", *h) for p, h in hours.items()]
        return spark.createDataFrame(rows, "park_id string, position int, date string, o string, c string").select("park_id", "position", "date", F.to_timestamp("o").alias("opens"), F.to_timestamp("c").alias("closes"))

    feed.land("a", ("17:00", "p", "1", 5), ("17:00", "q", "2", 5))
    feed.run(schedule=schedule)
    assert feed.stored() == [("17:00", "p", "1")]
    hours["q"] = ("2026-07-01 17:00:00", "2026-07-01 23:00:00")
    feed.land("b", ("17:30", "q", "2", 5))
    feed.run(schedule=schedule)
    assert feed.stored() == [("17:00", "p", "1"), ("17:30", "q", "2")] and len(asked) == 2


def test_unchanged_snapshots_write_nothing(feed, tmp_path):
    feed.land("a", ("17:00", "p", "1", 5), ("17:00", "p", "2", 5), ("17:00", "q", "3", 1))
    feed.run(changes_only=True)
    files = sorted(p for p in (tmp_path / "out").rglob("*.parquet"))
    feed.land("b", ("17:10", "p", "2", 5), ("17:10", "p", "1", 5), ("17:10", "q", "3", 1))
    feed.run(changes_only=True)
    assert files == sorted(p for p in (tmp_path / "out").rglob("*.parquet"))
    feed.land("c", ("17:20", "p", "1", 5), ("17:20", "p", "2", 6), ("17:20", "q", "3", 1))
    feed.run(changes_only=True)
    assert [r for r in feed.stored() if r[0] == "17:20"] == [("17:20", "p", "1"), ("17:20", "p", "2")]


def test_refresh_every_so_often(feed):
    feed.land("a", ("17:00", "p", "1", 5))
    query = stream.collect(feed.spark, str(feed.landed), feed.target, feed.checkpoint, every="1 second")
    try:
        query.processAllAvailable()
        feed.land("b", ("17:10", "p", "1", 5))
        query.processAllAvailable()
    finally:
        query.stop()
    assert [t for t, *_ in feed.stored()] == ["17:00", "17:10"]


def test_signatures_merge(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("string").alias("v"), F.when(F.col("id") % 3 > 0, 1).alias("w"))
    named = lambda made: [v.alias(k) for k, v in made.items()]
    whole = rows.agg(*named(items.content_signature(["v", "w"]))).first()
    parts = rows.repartition(5).groupBy("k").agg(*named(items.content_signature(["v", "w"])))
    assert parts.agg(*named(items.merged_signature())).first() == whole
    assert rows.withColumn("w", F.lit(1)).agg(*named(items.content_signature(["v", "w"]))).first() != whole
