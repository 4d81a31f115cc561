"""Ordinals, neighbours and running values of keys that may hold most of all rows.

A window by key sorts all rows of a key in one task. So keys are first counted in hash buckets, whose number is fixed by the
shuffle partitions: in a bucket that isn't far above the mean no key can be a task's burden, and plain windows do. The
rows of heavy buckets are range-partitioned by key and order instead, so a key's rows lie in order over as many partitions
(blocks) as they need. Windows run within a block, and what a block takes over from those before it (or after it) comes
from one small row for each key and block. At most two keys of a block go beyond it, so what is broadcast has two rows for
each shuffle partition at most, whatever the data. Both ways give the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.workspace import Workspace, shuffle_partitions

BLOCK = "__block"


#: A bucket is heavy with this many times the rows of the mean bucket, and this many rows at least.
HEAVY_TIMES, HEAVY_ROWS = 4, 200_000
#: Buckets for each shuffle partition.
BUCKETS = 4


class Ordered:
    """``rows`` in the order ``order`` within ``keys``, for columns that depend on that order.

    ``order`` should tell rows apart: rows that are equal in it stay in one block, in no defined order. Nulls come first,
    and null keys are a key. Columns of ``rows`` mustn't begin with two underscores. One small job counts the buckets at
    once. Blocks are written, as the borders of a range partitioning may differ when it is planned again.

    With ``dealt``, some of the keys, light rows are dealt by these alone, so all of them stay together for what follows.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str], dealt: Sequence[str] | None = None):
        spark = rows.sparkSession
        self.keys, self.order, self.columns = list(keys), list(order), rows.columns
        parts = shuffle_partitions(spark)
        bucket = F.pmod(F.xxhash64(*(dealt or self.keys)), F.lit(parts * BUCKETS))
        counts = {r.b: r.n for r in rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        least = max(HEAVY_ROWS, HEAVY_TIMES * sum(counts.values()) / (parts * BUCKETS))
        heavy = [b for b, n in counts.items() if n > least]
        self.light, self.blocks = rows, None
        if heavy:
            self.light = rows.where(~bucket.isin(heavy))
            ranged = rows.where(bucket.isin(heavy)).repartitionByRange(parts, *self.keys, *self.order)
            self.blocks = Workspace(spark, "ordered").table(ranged.withColumn(BLOCK, F.spark_partition_id()), "blocks")
        if dealt:
            self.light = self.light.repartition(*dealt)
        self._local: dict = {}  # by window function over a block or a key: made from the windows in rising and falling order
        self._edges: dict[str, Column] = {}  # by aggregate of a block
        self._carried: dict[str, Column] = {}  # by window function over a key's blocks
        self._merge: dict = {}
        self._forth = Window.partitionBy(*self.keys).orderBy(BLOCK)
        self._back = Window.partitionBy(*self.keys).orderBy(F.col(BLOCK).desc())

    def _column(self, name: str, local, edge: Column, carried, merge) -> Ordered:
        self._local[name], self._edges[f"__e_{name}"] = local, edge
        self._carried[f"__c_{name}"] = carried(F.col(f"__e_{name}"))
        self._merge[name] = merge
        return self

    def _locals(self, *within: str) -> dict[str, Column]:
        up = Window.partitionBy(*self.keys, *within).orderBy(*self.order)
        down = Window.partitionBy(*self.keys, *within).orderBy(*[F.col(c).desc() for c in self.order])
        return {f"__l_{k}": f(up, down) for k, f in self._local.items()}

    def _before(self, w=None):
        return (w or self._forth).rowsBetween(Window.unboundedPreceding, -1)

    def _place(self) -> Column:
        return F.struct(*self.order)

    def ordinal(self, name: str) -> Ordered:
        """The row's number within its key, from 1."""
        return self._column(name, lambda up, down: F.row_number().over(up).cast("long"), F.count(F.lit(1)), lambda e: F.sum(e).over(self._before()), lambda here, c: here + F.coalesce(c, F.lit(0)))

    def total(self, name: str, value: Column) -> Ordered:
        """The sum of the values up to this row and with it; nulls count as nothing."""
        here = lambda up, down: F.sum(value).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return self._column(name, here, F.sum(value), lambda e: F.sum(e).over(self._before()), lambda here, c: F.coalesce(here + c, here, c))

    def previous(self, name: str, value: Column) -> Ordered:
        """The value of the row before, null for the first row of a key."""
        here = lambda up, down: F.struct(F.row_number().over(up).alias("n"), F.lag(value).over(up).alias("v"))
        return self._column(name, here, F.max_by(value, self._place()), lambda e: F.lag(e).over(self._forth), lambda here, c: F.when(here["n"] == 1, c).otherwise(here["v"]))

    def last(self, name: str, value: Column) -> Ordered:
        """The last value that isn't null, up to this row and with it."""
        here = lambda up, down: F.last(value, True).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return self._column(name, here, F.max_by(value, F.when(value.isNotNull(), self._place())), lambda e: F.last(e, True).over(self._before()), lambda here, c: F.coalesce(here, c))

    def following(self, name: str, value: Column) -> Ordered:
        """The first value that isn't null, from this row on."""
        here = lambda up, down: F.last(value, True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return self._column(name, here, F.min_by(value, F.when(value.isNotNull(), self._place())), lambda e: F.last(e, True).over(self._before(self._back)), lambda here, c: F.coalesce(here, c))

    def frame(self) -> DataFrame:
        """The rows with the columns asked for."""
        none = F.lit(None)
        light = self.light.withColumns(self._locals()).select(*self.columns, *[f(F.col(f"__l_{k}"), none).alias(k) for k, f in self._merge.items()])
        if self.blocks is None:
            return light
        edges = self.blocks.groupBy(*self.keys, BLOCK).agg(*[v.alias(k) for k, v in self._edges.items()])
        several = F.count(F.lit(1)).over(Window.partitionBy(*self.keys)).alias("__n")
        carried = edges.select(*self.keys, BLOCK, several, *[v.alias(k) for k, v in self._carried.items()]).where("__n > 1").drop("__n")
        carried = carried.select(F.col(BLOCK).alias("__b"), *[F.col(c).alias(f"__k_{c}") for c in self.keys], *self._carried)
        same = F.col(BLOCK) == F.col("__b")
        for c in self.keys:
            same &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        placed = self.blocks.withColumns(self._locals(BLOCK)).join(F.broadcast(carried), same, "left")
        return light.unionByName(placed.select(*self.columns, *[f(F.col(f"__l_{k}"), F.col(f"__c_{k}")).alias(k) for k, f in self._merge.items()]))
