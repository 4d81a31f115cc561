"""What leaves the engine for other readers: single text files, the latest snapshot and report, archives, caches with a manifest.

Tables that belong together are published as versions, see ``versions``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import archives, object_uri
from tidemark.plans.archive import upload  # noqa: F401  part of what is published
from tidemark.plans.versions import Published

#: Excel and other readers tell UTF-8 by this mark at the start of a file.
MARK = "﻿"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def export_csv(rows: DataFrame, folder: str, columns: list[str], name: str = "wait_times", by: str = "file_date") -> None:
    """One CSV file for each value of ``by``, ``name_<value>.csv``, with a byte order mark and the columns in this order.

    A value's rows go to one task each, as one file asks for it; the folders that Spark writes are renamed, and other values' files stay.
    """
    stage = f"{folder}/_stage-{uuid.uuid4().hex}"
    texts = rows.select(F.col(by).alias("_by"), *[F.col(c).cast("string").alias(MARK + c if k == 0 else c) for k, c in enumerate(columns)])
    texts.repartition("_by").write.partitionBy("_by").options(header=True, emptyValue="", nullValue="", escape='"', maxRecordsPerFile=0).csv(stage)
    _settle(rows.sparkSession, stage, folder, name)


def export_lines(rows: DataFrame, folder: str, line: str, order: str, name: str = "wait_times", by: str = "file_date") -> None:
    """The same for lines of text, in the order given."""
    stage = f"{folder}/_stage-{uuid.uuid4().hex}"
    texts = rows.select(F.col(by).alias("_by"), F.col(order).alias("_at"), F.col(line).alias("value")).repartition("_by").sortWithinPartitions("_by", "_at")
    texts.select("_by", "value").write.partitionBy("_by").options(maxRecordsPerFile=0).text(stage)
    _settle(rows.sparkSession, stage, folder, name)


def _settle(spark: SparkSession, stage: str, folder: str, name: str) -> None:
    """Gives the one file of each value its name; an error, and nothing moved for that value, if there are several."""
    fs, path = _files(spark, folder)
    for status in fs.listStatus(path(stage)):
        if status.isDirectory():
            value = status.getPath().getName().split("=", 1)[1]
            parts = [f.getPath() for f in fs.listStatus(status.getPath()) if f.getPath().getName().startswith("part-")]
            if len(parts) != 1:
                raise RuntimeError(f"{value} was written as {len(parts)} files in {stage}; none was moved")
            target = path(f"{folder}/{name}_{value}.csv")
            fs.delete(target, False)
            fs.rename(parts[0], target)
    fs.delete(path(stage), True)


def latest_snapshot(rows: DataFrame, skipped: list[str]) -> DataFrame:
    """One row with the JSON of the latest snapshot: its times, the number of its rows, the skipped parks, the rows.

    A snapshot has a row per ride of the parks, so it is small whatever the table it is taken from.
    """
    last = rows.agg(F.max("snapshot_utc").alias("snapshot_utc"))
    mine = rows.join(last, "snapshot_utc", "left_semi")
    record = F.struct(*sorted(rows.columns))
    told = mine.groupBy("snapshot_utc").agg(F.count(F.lit(1)).alias("rowCount"), F.sort_array(F.collect_list(record)).alias("rows"))
    return told.select(F.to_json(F.struct("snapshot_utc", "rowCount", F.array(*[F.lit(p) for p in skipped]).cast("array<string>").alias("skippedParks"), "rows")).alias("json"))


def latest_report(report: DataFrame) -> DataFrame:
    """The report of the last date."""
    return report.join(report.agg(F.max("file_date").alias("file_date")), "file_date", "left_semi")


def assumed(files: DataFrame, base: str) -> DataFrame:
    """(path, raw_archive_id, object_uri) of files that are taken to lie in an object store already."""
    found = archives(files)
    return found.select("path", "raw_archive_id", object_uri(F.lit(base), F.col("raw_archive_id"), F.col("source_name")).alias("object_uri"))


def manifest(parks: DataFrame, endpoints: list[str], base: str, folder: str) -> DataFrame:
    """(park, endpoint, url, file) for each park (park_id, name, entity_id) and endpoint."""
    rows = parks.withColumn("endpoint", F.explode(F.array(*[F.lit(e) for e in endpoints])))
    return rows.select(F.col("name").alias("park"), "endpoint", F.concat_ws("/", F.lit(base.rstrip("/")), "entity_id", "endpoint").alias("url"), F.format_string(f"{folder.rstrip('/')}/%s.%s.json", "park_id", "endpoint").alias("file"))


def cache_snapshot(documents: DataFrame, listed: DataFrame, folder: str) -> DataFrame:
    """Publishes what each url of the manifest answered (url, json) and the manifest, as one version; an error if an answer is missing. Returns the manifest."""
    met = listed.join(documents, "url", "left")
    missing = met.where("json is null").select("url").first()
    if missing:
        raise RuntimeError(f"no answer from {missing.url}")
    store = Published(listed.sparkSession, folder)
    store.publish({"documents": met.select("park", "endpoint", "url", "file", "json"), "manifest": listed})
    return store.read("manifest")
