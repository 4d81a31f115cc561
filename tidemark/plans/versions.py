"""Tables that are published together: readers see all of a version or none of it.

Data goes to a folder of its own for each attempt. A version exists from the moment its small log entry does, which is
written last, under the next number, and only if no other writer was faster. The entry names the folders of each
table, for tables in parts one for each value of a column, so parts that a version doesn't replace are carried over
without being copied. A run that breaks off leaves folders that no entry names; readers stay on the version before.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PART = "__part"


class Conflict(RuntimeError):
    """Another writer has published this version."""


@dataclass(frozen=True)
class Version:
    number: int
    batch: int | None
    tables: dict


class Published:
    """The versions under ``folder``. The driver handles names and log entries, tasks the rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def current(self) -> Version | None:
        """The last version, None before the first."""
        numbers = [n for n in self._names(f"{self.folder}/log") if n.endswith(".json")]
        if not numbers:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/log/{numbers[-1]}"))
        try:
            return Version(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def read(self, table: str, parts: list[str] | None = None) -> DataFrame:
        """A table of the current version, or the parts of it that are asked for and there."""
        version = self.current()
        if version is None or table not in version.tables:
            raise LookupError(f"no published table {table} in {self.folder}")
        entry = version.tables[table]
        schema = StructType.fromJson(json.loads(entry["schema"]))
        paths = [f"{self.folder}/data/{p}" for k, p in entry["parts"].items() if parts is None or k in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)

    def publish(self, tables: dict[str, DataFrame], by: dict[str, str] | None = None, batch: int | None = None) -> Version:
        """Writes the tables and then the entry that makes them the current version.

        A table in ``by`` is in parts by that column: parts without new rows stay as they were. Other tables are replaced, and
        tables that aren't given stay. ``batch`` numbers the caller's batches: one that isn't after the current version's has
        been published before, and nothing is written. ``Conflict`` if another writer was faster.
        """
        before = self.current()
        if batch is not None and before and before.batch is not None and before.batch >= batch:
            return before
        number = before.number + 1 if before else 1
        attempt = f"{number:010d}-{uuid.uuid4().hex}"
        entries = dict(before.tables) if before else {}
        for name, rows in tables.items():
            column = (by or {}).get(name)
            where = f"{attempt}/{name}"
            if column:
                part = F.coalesce(F.col(column).cast("string"), F.lit("null"))
                rows.withColumn(_PART, part).write.partitionBy(_PART).parquet(f"{self.folder}/data/{where}")
                folders = [n for n in self._names(f"{self.folder}/data/{where}") if n.startswith(f"{_PART}=")]
                unescape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
                fresh = {unescape(n.split("=", 1)[1]): f"{where}/{n}" for n in folders}
                old = entries[name]["parts"] if name in entries else {}
                entries[name] = {"schema": rows.schema.json(), "parts": old | fresh}
            else:
                rows.write.parquet(f"{self.folder}/data/{where}")
                entries[name] = {"schema": rows.schema.json(), "parts": {"": where}}
        version = Version(number, batch, entries)
        self._enter(version)
        return version

    def _enter(self, version: Version) -> None:
        """Makes the entry, whole or not at all: renaming to a name that is taken fails."""
        log = self._path(f"{self.folder}/log")
        self._fs.mkdirs(log)
        draft, final = self._path(f"{self.folder}/log/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/log/{version.number:010d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(version.__dict__).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version.number} of {self.folder} was published by another writer")

    def clean(self, keep: int = 2) -> list[str]:
        """Deletes data that none of the last ``keep`` versions names, their older entries first; the names of the folders. Not to be run beside a writer."""
        names = [n for n in self._names(f"{self.folder}/log") if n.endswith(".json")]
        for n in names[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/log/{n}"), False)
        used = set()
        for n in names[-keep:]:
            stream = self._fs.open(self._path(f"{self.folder}/log/{n}"))
            used |= {p.split("/", 1)[0] for t in json.loads(bytes(stream.readAllBytes()).decode())["tables"].values() for p in t["parts"].values()}
            stream.close()
        gone = [n for n in self._names(f"{self.folder}/data") if n not in used]
        for n in gone:
            self._fs.delete(self._path(f"{self.folder}/data/{n}"), True)
        return gone
