"""Exact deduplication by deterministic block naming.

Normalised texts are cut into fixed-size blocks. All blocks are sorted, and equal blocks get the same integer, their
rank among the distinct blocks (the name). Then adjacent names are paired, the pairs are sorted and named in the same
way, and so on until one name is left of each document. Names are ranks of compared contents, never hashes, so two
documents share (level, name) exactly if their texts are equal. A hash of the block only leads the sort key, so that
range partitioning samples a few bytes a row.

The sort is by (hash, row), so a block that a third of all documents hold is spread over as many partitions as its
rows need; a run of equal blocks that spans partitions is joined up by comparing the partitions' edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import RID, SPACE, Workspace, shuffle_partitions, with_rid

BLOCK_BYTES = 8192


def _runs(keys: list[str], schema: pa.Schema):
    """For sorted rows: the number of each row's run of equal keys within the partition, then a row about its edges."""

    def scan(batches):
        part, runs, last, first = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in keys:
                column = batch.column(k)
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            head = tuple(batch.column(k)[0].as_py() for k in keys)
            first = head if first is None else first
            new[0] = head != last
            number = runs + np.cumsum(new) - 1
            runs, last = int(number[-1]) + 1, tuple(batch.column(k)[n - 1].as_py() for k in keys)
            empty = {f"{e}_{k}": pa.nulls(n, schema.field(f"{e}_{k}").type) for e in ("first", "last") for k in keys}
            made = {c: batch.column(c) for c in ("rid", "pos", "left")} | {"part": pa.array(np.full(n, part), pa.int32()), "run": pa.array(number, pa.int64())} | empty
            yield pa.RecordBatch.from_arrays([made[f.name] for f in schema], schema=schema)
        if first is not None:
            edge = {"rid": None, "pos": None, "left": None, "part": part, "run": runs} | {f"first_{k}": v for k, v in zip(keys, first)} | {f"last_{k}": v for k, v in zip(keys, last)}
            yield pa.RecordBatch.from_pylist([edge], schema=schema)

    return scan


def name_rows(rows: DataFrame, keys: dict[str, str], spread: list[str], ws: Workspace, tag: str) -> DataFrame:
    """(rid, pos, left, name): name is the rank of the row's keys among the distinct ones, in the order (``spread``, keys).

    ``spread`` are hash columns of the keys. A written table, so that names stay what they are. The driver gets a number for
    each partition.
    """
    spark = rows.sparkSession
    kind = {"binary": pa.binary(), "long": pa.int64()}
    fields = [("rid", pa.int64()), ("pos", pa.int64()), ("left", pa.int64()), ("part", pa.int32()), ("run", pa.int64())]
    fields += [(f"{e}_{k}", kind[t]) for e in ("first", "last") for k, t in keys.items()]
    ddl = "rid long, pos long, left long, part int, run long, " + ", ".join(f"{e}_{k} {t}" for e in ("first", "last") for k, t in keys.items())
    order = list(dict.fromkeys([*spread, *keys, "rid", "pos"]))
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *spread, "rid").sortWithinPartitions(*order)
    found = ws.table(ranged.mapInArrow(_runs(list(keys), pa.schema(fields)), ddl), tag)
    # One row for each partition: its number of runs, less one if its first run continues that of the partition before.
    edges, w = found.where("rid is null"), Window.orderBy("part")
    goes_on = F.lit(True)
    for k in keys:
        goes_on &= F.col(f"first_{k}") == F.lag(f"last_{k}").over(w)
    edges = edges.withColumn("less", F.coalesce(goes_on, F.lit(False)).cast("long"))
    base = edges.select("part", (F.sum(F.col("run") - F.col("less")).over(w) - F.col("run")).alias("base")).collect()
    base = spark.createDataFrame(base, "part int, base long")
    return found.where("rid is not null").join(F.broadcast(base), "part").select("rid", "pos", "left", (F.col("base") + F.col("run")).alias("name"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of documents whose texts are equal after each run of white space is made one blank.

    Returns a row per input row: the id, keep_id (smallest id of the group), group_size, kept, text_sha256. A null text
    counts as empty; empty texts are equal to each other. Rows that share an id stay rows of their own: of a group
    one row alone is kept, and a null id counts as larger than any other. Columns beside id and text are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    rows, _ = with_rid(docs, id_col, ws, text_col)
    rows = rows.select(F.col(RID).alias("rid"), F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, " ").cast("binary").alias("data"))
    count = F.greatest(F.lit(1), F.ceil(F.length("data") / block_bytes)).cast("long")
    cut = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.substring(F.col("data"), (i * block_bytes + 1).cast("int"), F.lit(block_bytes)))
    blocks = rows.select("rid", count.alias("left"), F.posexplode(cut).alias("pos", "block")).withColumn("pos", F.col("pos").cast("long"))
    named = name_rows(blocks.withColumn("h", F.xxhash64("block")).withColumn("g", F.hash("block")), {"block": "binary"}, ["h", "g"], ws, "level0")
    # A document with one name left is complete; the others go on in pairs.
    whole = lambda level: named.where("left = 1").select("rid", F.lit(level).alias("level"), "name")
    done, level, most = whole(0), 0, rows.agg(F.max(count)).first()[0] or 1
    while most > 1:
        name = lambda side: F.max(F.when(F.col("pos") % 2 == side, F.col("name")))
        pairs = named.where("left > 1").groupBy("rid", F.expr("pos div 2").alias("pos"), F.expr("(left + 1) div 2").alias("left")).agg(name(0).alias("a"), F.coalesce(name(1), F.lit(-1)).alias("b"))
        level, most = level + 1, (most + 1) // 2
        named = name_rows(pairs.withColumn("h", F.xxhash64("a", "b")).withColumn("g", F.hash("a", "b")), {"a": "long", "b": "long"}, ["h", "g"], ws, f"level{level}")
        done = done.unionByName(whole(level))
    ids = rows.select("rid", "id", F.sha2("data", 256).alias("text_sha256")).join(done, "rid")
    ids = ws.table(ids, "identities")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    groups = ws.table(ids.groupBy("level", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = ids.join(groups, ["level", "name"])
    return out.select(F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("first.rid") == F.col("rid")).alias("kept"), "text_sha256")
