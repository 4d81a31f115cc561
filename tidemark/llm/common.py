"""Helpers that the operators of this subpackage share.

Intermediate results that are read more than once, or whose rows must not change when a lost executor's tasks
run again, are written as Parquet under the shared folder of the cluster (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.workspace import Workspace, shuffle_partitions  # noqa: F401  for the operators of this subpackage

#: White space of the contracts: blank and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
RID = "__row_number"


def with_rid(docs: DataFrame, id_col: str, ws: Workspace, *keep: str) -> tuple[DataFrame, bool]:
    """``docs`` cut to ``keep`` with a unique non-null long ``__row_number`` beside the id.

    Also returns whether ``__row_number`` is the id, as it is where ids are unique integers. If ids are null or repeated the rows are
    written once with a number of their own, so that every row still counts as a row.
    """
    cols = [F.col(c) for c in dict.fromkeys([id_col, *keep])]
    odd = docs.groupBy(F.col(id_col).alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or i is null")
    if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") and odd.isEmpty():
        return docs.select(F.col(id_col).cast("long").alias(RID), *cols), True
    return ws.table(docs.select(F.monotonically_increasing_id().alias(RID), *cols), "numbered"), False


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 places where its values begin; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, at - at[0] if len(column) else np.zeros(1, np.int64)


def by_bytes(column: pa.Array, limit: int):
    """Slices (start, stop) of a string column with about ``limit`` bytes each, one value at least."""
    _, at = utf8(column)
    start, n = 0, len(at) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield start, min(stop, n)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
