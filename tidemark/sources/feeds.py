"""Feeds over HTTP as a data source, and what is read when a feed is down: caches and samples, told apart by their source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.files import first_available


class _Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split(" ") if u]
        self.seconds = float(options.get("seconds", "30"))

    def partitions(self):
        return [_Url(u) for u in self.urls]

    def read(self, partition):
        from urllib.request import Request, urlopen

        # An answer other than 2xx is an error, and so the task and the query fail.
        with urlopen(Request(partition.url, headers={"Cache-Control": "no-store"}), timeout=self.seconds) as answer:
            yield partition.url, answer.read().decode("utf-8")


class JsonFeeds(DataSource):
    """``spark.read.format("json_feeds").option("urls", "a b c").load()``: (url, json), one task for each url."""

    @classmethod
    def name(cls):
        return "json_feeds"

    def schema(self):
        return "url string, json string"

    def reader(self, schema):
        return _Reader(self.options)


def fetch(spark: SparkSession, urls: list[str]) -> DataFrame:
    spark.dataSource.register(JsonFeeds)
    return spark.read.format("json_feeds").option("urls", " ".join(urls)).load()


def read_through(spark: SparkSession, live: Callable[[], DataFrame], cache: str, *more: tuple[str, Callable[[], DataFrame]]) -> DataFrame:
    """Live rows, published as the new version of the cache; if they can't be read, the cache, then other sources in order. Column ``source`` says which.

    A feed that breaks off leaves the cache at the version before.
    """
    from tidemark.plans.versions import Published

    store = Published(spark, cache)

    def fresh() -> DataFrame:
        store.publish({"rows": live()})
        return store.read("rows")

    rows, name = first_available(("live", fresh), ("cache", lambda: store.read("rows")), *more)
    return rows.withColumn("source", F.lit(name))
