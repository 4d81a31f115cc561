"""Versions: whole or not there, parts carried over, batches published once."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans.versions import Conflict, Published


def rows(spark, *values):
    return spark.createDataFrame(list(values), "file_date string, n int")


def read(store, name, parts=None):
    return sorted(map(tuple, store.read(name, parts).collect()), key=str)


def test_parts_stay(spark, tmp_path):
    store = Published(spark, f"file://{tmp_path}/s")
    assert store.current() is None
    with pytest.raises(LookupError):
        store.read("a")
    store.publish({"a": rows(spark, ("1", 1), ("2:x", 2), (None, 3)), "b": rows(spark, ("x", 0))}, by={"a": "file_date"})
    store.publish({"a": rows(spark, ("2:x", 5))}, by={"a": "file_date"})
    assert read(store, "a") == [("1", 1), ("2:x", 5), (None, 3)] and read(store, "b") == [("x", 0)]
    assert read(store, "a", ["2:x"]) == [("2:x", 5)] and read(store, "a", ["9"]) == []
    assert len(store.clean(1)) == 0 and read(store, "a") == [("1", 1), ("2:x", 5), (None, 3)]
    store.publish({"a": rows(spark, ("1", 7)), "b": rows(spark)})
    assert read(store, "a") == [("1", 7)] and read(store, "b") == []
    assert len(store.clean(1)) == 2 and read(store, "a") == [("1", 7)]


def test_broken_off_between_tables(spark, tmp_path):
    store = Published(spark, f"file://{tmp_path}/s")
    store.publish({"a": rows(spark, ("1", 1)), "b": rows(spark, ("1", 1))})
    broken = rows(spark, ("1", 2)).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.publish({"a": rows(spark, ("1", 2)), "b": broken})
    assert read(store, "a") == read(store, "b") == [("1", 1)] and store.current().number == 1
    store.publish({"a": rows(spark, ("1", 3)), "b": rows(spark, ("1", 3))})
    assert read(store, "a") == read(store, "b") == [("1", 3)]
    assert len(store.clean()) == 1  # what the broken run has left


def test_two_writers(spark, tmp_path):
    store, other = Published(spark, f"file://{tmp_path}/s"), Published(spark, f"file://{tmp_path}/s")
    before = store.current
    other.publish({"a": rows(spark, ("1", 1))})
    store.current = lambda: None  # looked before the other was done
    with pytest.raises(Conflict):
        store.publish({"a": rows(spark, ("1", 2))})
    store.current = before
    assert read(store, "a") == [("1", 1)]


def test_batches_once(spark, tmp_path):
    store = Published(spark, f"file://{tmp_path}/s")
    store.publish({"a": rows(spark, ("1", 1))}, batch=4)
    store.publish({"a": rows(spark, ("1", 2))}, batch=4)
    assert read(store, "a") == [("1", 1)]
    store.publish({"a": rows(spark, ("1", 2))}, batch=5)
    assert read(store, "a") == [("1", 2)]
