"""Observations as a stream: landed files become appended, identified rows; replays add nothing, and state outlives batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import Settings
from tidemark.operators.items import content_signature
from tidemark.operators.lineage import IDENTITY, content_id
from tidemark.operators.ordered import Ordered
from tidemark.operators.windows import collecting
from tidemark.plans.versions import Published
from tidemark.sources.files import RAW_COLUMNS, typed


def observation_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the 14 columns as they land, without empty rows."""
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    rows = spark.readStream.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(folder)
    return rows.where(F.coalesce(*RAW_COLUMNS).isNotNull())


def identified(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Typed rows with an id of their contents. Late rows are kept: age is a flag, never a reason to drop."""
    return typed(rows.withColumn("row_id", content_id(*[F.coalesce(F.col(c), F.lit("")) for c in [*IDENTITY, "is_open", "wait_time_minutes"]])), settings)


STATE = {"kept": "service_date string, snapshot_ts timestamp", "signatures": "park_id string, snapshot_ts timestamp, signature struct<n: bigint, x: bigint, s: decimal(38,0)>"}
#: What tells two snapshots of a park apart.
SEEN = ["ride_id", "is_open", "wait"]


def thinned(rows: DataFrame, kept: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rows`` (service_date, snapshot_ts, ...) of the snapshots that are kept: those that were, and those at least the minimum interval from all that are.

    ``kept`` (service_date, snapshot_ts) holds the snapshots kept before. Snapshots of a date are taken by time, whichever batch
    they come in; a date's distinct snapshots are one small list. Rows without an instant are kept.
    """
    seen = rows.where("snapshot_ts is not null").select("service_date", "snapshot_ts").distinct()
    seen = seen.groupBy("service_date").agg(F.sort_array(F.collect_list(F.unix_micros("snapshot_ts"))).alias("new"))
    had = kept.groupBy("service_date").agg(F.collect_set(F.unix_micros("snapshot_ts")).alias("old"))
    least = int(settings.min_interval_minutes * 60_000_000)
    near = lambda all_, t: F.exists(all_, lambda k: (k != t) & (F.abs(k - t) < least))
    old = F.coalesce("old", F.array().cast("array<bigint>"))
    add = lambda all_, t: F.when(F.array_contains(all_, t) | near(all_, t), all_).otherwise(F.concat(all_, F.array(t)))
    stay = seen.join(had, "service_date", "left").select("service_date", F.explode(F.aggregate("new", old, add)).alias("t")).select("service_date", F.timestamp_micros("t").alias("snapshot_ts"))
    return rows.where("snapshot_ts is null").unionByName(rows.join(stay, ["service_date", "snapshot_ts"], "left_semi"))


def changed_snapshots(rows: DataFrame, before: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of those snapshots of a park whose contents differ from the park's snapshot before them, and the last signature of each park.

    ``before`` has the last signatures (park_id, snapshot_ts, signature) of what was seen earlier. Late snapshots are compared with
    the one before them where that is known.
    """
    signature = F.struct(*[v.alias(k) for k, v in content_signature(columns or SEEN).items()]).alias("signature")
    new = rows.groupBy("park_id", "snapshot_ts").agg(signature)
    new = before.select("park_id", "snapshot_ts", "signature", F.lit(0).alias("is_new")).unionByName(new.withColumn("is_new", F.lit(1)))
    placed = Ordered(new, ["park_id"], ["snapshot_ts", "is_new"]).previous("last", F.col("signature")).frame()
    other = placed.where("is_new = 1 and not (signature <=> last)").select("park_id", "snapshot_ts")
    latest = placed.groupBy("park_id").agg(F.max_by(F.struct("snapshot_ts", "signature"), F.struct("snapshot_ts", "is_new")).alias("e")).select("park_id", "e.*")
    return rows.join(other, ["park_id", "snapshot_ts"], "left_semi"), latest


def append_new(rows: DataFrame, target: str) -> None:
    """Adds the rows whose id is not stored for their service date, so a repeated batch changes nothing.

    Only the dates of the batch are read back, by partition pruning.
    """
    spark, fresh = rows.sparkSession, rows.dropDuplicates(["row_id"])
    try:
        stored = spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        have = stored.select("row_id", F.col("service_date").cast("string").alias("service_date"))
        fresh = fresh.join(have, ["service_date", "row_id"], "left_anti")
    if not fresh.isEmpty():
        fresh.write.mode("append").partitionBy("service_date").parquet(target)


@dataclass
class Collector:
    """For ``foreachBatch``: what of a batch is stored under ``target``, with state that outlives batches and restarts.

    ``schedule`` is called for each batch and gives the opening hours as they are then; rows of parks outside their collection
    windows go. Then snapshots too near to a kept one go, and with ``changes_only`` those that say the same as the park's
    snapshot before. State is published after the rows, under the batch's number: a batch that is repeated finds the state it began
    with, decides the same and adds what is missing; one whose state is published has nothing to add.
    """

    target: str
    settings: Settings = Settings()
    schedule: Callable[[], DataFrame] | None = None
    changes_only: bool = False

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Published(spark, f"{self.target.rstrip('/')}_state")
        version = store.current()
        if version and version.batch is not None and version.batch >= number:
            return
        state = {k: store.read(k) if version and k in version.tables else spark.createDataFrame([], ddl) for k, ddl in STATE.items()}
        batch = batch.withColumn("service_date", F.coalesce(F.nullif("snapshot_park_date", F.lit("")), F.lit("unknown"))).persist()
        try:
            rows = batch if self.schedule is None else gated(batch, self.schedule(), self.settings)
            dates = batch.select("service_date").distinct()
            known = state["kept"].join(dates, "service_date", "left_semi")
            rows = thinned(rows, known, self.settings) if self.settings.min_interval_minutes > 0 else rows
            kept = rows.where("snapshot_ts is not null").select("service_date", "snapshot_ts").union(known).distinct()
            tables = {"kept": kept}
            if self.changes_only:
                rows, tables["signatures"] = changed_snapshots(rows, state["signatures"])
            append_new(rows, self.target)
            store.publish(tables, by={"kept": "service_date"}, batch=number)
        finally:
            batch.unpersist()


def gated(rows: DataFrame, schedule: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A batch's rows of parks that are within their collection windows at the snapshot."""
    asked = rows.select("park_id", F.col("snapshot_ts").alias("at")).distinct()
    open_ = collecting(asked, schedule, settings).where("should_collect").select("park_id", F.col("at").alias("snapshot_ts"))
    return rows.join(open_, ["park_id", "snapshot_ts"], "left_semi")


def collect(
    spark: SparkSession, folder: str, target: str, checkpoint: str, settings: Settings = Settings(), every: str | None = None,
    schedule: Callable[[], DataFrame] | None = None, changes_only: bool = False,
) -> StreamingQuery:
    """Starts the stream: what has landed and then ends, or every so often ("5 minutes"). See ``Collector``."""
    rows = identified(observation_stream(spark, folder), settings)
    writer = rows.writeStream.foreachBatch(Collector(target, settings, schedule, changes_only)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
