"""Order across partitions: the same as windows by key, with one key over many partitions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import lineage, observations, ordered, windows
from tidemark.operators.ordered import BLOCK, Ordered


@pytest.fixture(scope="module")
def many(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    ordered.HEAVY_ROWS, rows = 200, ordered.HEAVY_ROWS
    yield spark
    ordered.HEAVY_ROWS = rows
    spark.conf.set("spark.sql.shuffle.partitions", before)


def table(spark, n=2000):
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.7 else r.choice(["a", "b", "c", None]), i // 2, i, None if r.random() < 0.6 else r.randrange(100)) for i in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t long, i long, v long")


def test_same_as_windows(many):
    rows = table(many)
    placed = Ordered(rows, ["k"], ["t", "i"])
    assert placed.blocks.where("k = 'hot'").select(BLOCK).distinct().count() > 3
    v = F.col("v")
    got = placed.ordinal("n").total("s", v).previous("p", v).last("l", v).following("f", v).frame()
    w = Window.partitionBy("k").orderBy("t", "i")
    up, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    said = rows.select("*", F.row_number().over(w).cast("long").alias("n"), F.sum(v).over(up).alias("s"), F.lag(v).over(w).alias("p"), F.last(v, True).over(up).alias("l"), F.first(v, True).over(on).alias("f"))
    assert got.columns == said.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, said.collect()), key=str)


def test_light_keys_need_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HEAVY_ROWS", 1_000_000)
    rows = table(spark)
    got = Ordered(rows, ["k"], ["t", "i"]).ordinal("n")
    assert got.blocks is None and got.frame().where("k = 'hot'").agg(F.max("n")).first()[0] == rows.where("k = 'hot'").count()


def test_no_rows(many):
    assert Ordered(table(many).limit(0), ["k"], ["t", "i"]).ordinal("n").previous("p", F.col("v")).frame().collect() == []


def plans(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_with_one_park(many):
    """All openings and instants of one park, against a loop."""
    stamp = lambda c: F.timestamp_seconds(F.col(c))
    r = random.Random(1)
    opens = [(k, s, s + 500) for k, s in enumerate(r.sample(range(0, 100_000), 300))]
    asked = r.sample(range(-5000, 110_000), 900)
    schedule = many.createDataFrame(opens, "position int, o long, c long").select(F.lit("p").alias("park_id"), "position", stamp("o").alias("opens"), stamp("c").alias("closes"))
    instants = many.createDataFrame([(a,) for a in asked], "a long").select(F.lit("p").alias("park_id"), stamp("a").alias("at"))
    found = windows.nearest(instants, schedule)
    got = {r.a: r.o for r in found.select(F.unix_seconds("at").alias("a"), F.unix_seconds("hours.opens").alias("o")).collect()}
    assert got == {a: min(opens, key=lambda e: (abs(e[1] - a), e[0]))[1] for a in asked}
    assert "windowspecdefinition(park_id#" in plans(found) and BLOCK in plans(found)
    assert windows.nearest(instants.withColumn("park_id", F.lit("other")), schedule).where("hours is not null").count() == 0


def test_lineage_of_one_key(many):
    """The n-th to the n-th where nearly all rows have one key."""
    rows = many.range(3000).select(F.when(F.col("id") % 10 > 0, "x").otherwise("y").alias("k"), F.col("id").alias("src_row"))
    raw = rows.withColumn("raw_observation_id", F.col("src_row").cast("string"))
    cleaned = rows.where("src_row % 3 = 0")
    got = {(r.src_row, r.raw_observation_id) for r in lineage.matched(cleaned, raw, ["k"]).collect()}
    want = set()
    for k in (0, 1):
        mine = [i for i in range(3000) if (i % 10 > 0) == k]
        ours = [i for i in mine if i % 3 == 0]
        want |= {(i, str(mine[n])) for n, i in enumerate(ours)}
    assert got == want


def test_lineage_deals_rows_once(spark):
    """Both sides by one exchange, an id that follows from the order after it; null keys match nothing."""
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5)], "k string, src_row long")
    ids = F.concat(F.lit("r"), F.col("src_row").cast("string"))
    got = lineage.matched(rows.where("src_row <> 1").withColumn("more", F.col("src_row") * 10), rows, ["k"], raw_id=ids)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and " concat(r, " not in plan[plan.index("Exchange ") :]
    assert got.columns == ["k", "ordinal", "src_row", "more", "raw_observation_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, 2, 20, "r1"), ("a", 2, 3, 30, "r2"), ("b", 1, 4, 40, "r4"), (None, 1, 5, 50, None)], key=str)


def test_changes_of_one_ride(many):
    states = [random.Random(9 + i).random() < 0.5 for i in range(1500)]
    rows = many.createDataFrame([("d", "p", "1", "Ride", "ride", i // 3, i, s) for i, s in enumerate(states)], "file_date string, park_id string, ride_id string, ride_name string, name string, t long, src_row long, is_open boolean")
    row = observations.ride_profiles(rows.withColumn("snapshot_ts", F.timestamp_seconds("t"))).first()
    assert (row.total_rows, row.open_rows, row.transitions) == (1500, sum(states), sum(a != b for a, b in zip(states, states[1:])))


def test_too_many_parks(spark, monkeypatch):
    monkeypatch.setattr(windows, "MOST_PARKS", 2)
    rows = spark.createDataFrame([("2024-01-01", f"p{i}") for i in range(3)], "file_date string, park_id string").withColumn("snapshot_ts", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    schedule = spark.createDataFrame([], "park_id string, position int, date string, opens timestamp, closes timestamp")
    with pytest.raises(Exception, match="more than 2 parks"):
        windows.collection_gaps(rows, schedule).collect()
