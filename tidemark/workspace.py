"""Written tables between steps, in the folder that the cluster shares.

What is read more than once, or must not change when a lost executor's tasks run again, is written as Parquet under
``spark.checkpoint.dir``. Lineage ends there.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_FREE_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is configured and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = tempfile.mkdtemp(prefix="tidemark-")
    return _own_dir["dir"]


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    """A setting of the session for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Workspace:
    """A folder of written tables for one operator call.

    ``table`` writes a DataFrame once and returns it as read back, so its lineage ends there. ``drop`` deletes tables
    no longer needed; the others go when the driver ends. With ``small`` tables are compressed harder, and the shuffle files
    of a table go as soon as it is written, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, small: bool = False):
        self.spark = spark
        self.small = small
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        if self.small:
            with _set(self.spark, _FREE_SHUFFLE, "true"):
                df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: nothing left to delete with
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
