"""Whole files copied under the hash of their contents, by the tasks that have read them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemark.operators.lineage import archives


@dataclass
class _Stored(WriterCommitMessage):
    written: int
    there: int


class _Writer(DataSourceWriter):
    def __init__(self, base: str):
        self.staging = f"{base}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Stored:
        """A file appears under its name whole or not at all, and the name follows from its contents: whichever attempt of a task comes first, or repeats it, the same is there."""
        from pyarrow.fs import FileSystem, FileType

        written = there = 0
        for row in iterator:
            if row.content is None:
                raise ValueError(f"no content for {row.object_uri}")
            fs, final = FileSystem.from_uri(row.object_uri)
            _, draft = FileSystem.from_uri(f"{self.staging}/{uuid.uuid4().hex}")
            if fs.get_file_info(final).type == FileType.File:
                there += 1
                continue
            for folder in (final, draft):
                fs.create_dir(folder.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(draft) as out:
                out.write(row.content)
            fs.move(draft, final)
            written += 1
        return _Stored(written, there)

    def commit(self, messages) -> None:
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileSystem, FileType

        fs, staging = FileSystem.from_uri(self.staging)
        if fs.get_file_info(staging).type == FileType.Directory:
            fs.delete_dir(staging)


class ContentStore(DataSource):
    """``df.write.format("content_store").option("base", uri).mode("append").save()`` for rows (object_uri, content)."""

    @classmethod
    def name(cls):
        return "content_store"

    def schema(self):
        return "object_uri string, content binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options["base"])


def upload(files: DataFrame, base: str) -> DataFrame:
    """Copies whole files (path, content) under their hash; (path, raw_archive_id, object_uri). What is there stays as it is.

    ``base`` is a URI that every machine can write to (file, hdfs, s3, gs, ...). Names of files that are only
    half there don't occur: a run that fails can be repeated, and leaves its staging folder at most.
    """
    base = base.rstrip("/") if "://" in base else f"file://{base.rstrip('/')}"
    uri = F.concat_ws("/", F.lit(base), F.lit("wait-times"), "raw_archive_id", "source_name").alias("object_uri")
    named = files.select("path", F.sha2("content", 256).alias("raw_archive_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("source_name"), "content")
    files.sparkSession.dataSource.register(ContentStore)
    named.select(uri, "content").write.format("content_store").option("base", base).mode("append").save()
    return archives(files).select("path", "raw_archive_id", uri)
