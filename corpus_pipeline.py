"""From raw documents to packed training sequences: five stages, each one of the numbered operators.

Each stage works on all rows that the one before kept. Between stages the documents are written as Parquet in the shared
folder and read again, so a lost executor never sends the work back past the stage it is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from tidemark.llm.common import RID, Workspace, with_rid
from tidemark.llm.queries import TOKENIZER, read, vocabulary

#: SQL can't express naive Bayes over hashed n-grams nor tokenisation; tests/llm holds a brute-force version.
ORACLE_SQL = None
ROW = "__stage_row"
#: Rows in a batch between Spark and Python. A batch of whole texts is held on both sides, by each task of an executor.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's batches to BATCH_ROWS, if they are larger. It stays, as stages run when they are written."""
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)


def _numbered(docs: DataFrame) -> DataFrame:
    """All columns and a unique row number, the doc_id itself where it is unique."""
    return with_rid(docs, "doc_id", Workspace(docs.sparkSession, "stage"), *docs.columns)[0].withColumnRenamed(RID, ROW)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language: without a letter, or with a score under 0.5."""
    _small_batches(spark)
    return language_id.accepted(docs, language_id.fit(language_id.training_rows(docs)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id stays."""
    rows = _numbered(docs)
    kept = exact_dedup.exact_groups(rows, ROW).where("kept").select(ROW)
    return rows.join(kept, ROW, "left_semi").drop(ROW)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their shingles of five words, the one with the smallest id stays."""
    rows = _numbered(docs)
    kept = jaccard_join.similar_groups(rows, ROW, words=5, percent=80).where(f"component_id = {ROW}").select(ROW)
    return rows.join(kept, ROW, "left_semi").drop(ROW)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(docs, vocabulary(TOKENIZER))


STAGES = [("language id", known_language), ("exact dedup", exact_copies), ("n-gram Jaccard", near_copies), ("decontamination", no_benchmark), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = read(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
