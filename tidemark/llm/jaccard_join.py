"""Exact set-similarity join of documents by the Jaccard similarity of their word shingles, skipping by set relations.

The index is that of prefix filtering: all shingles have one order, rare ones first, and two sets that are similar
enough share a shingle among the first few of each. Two kinds of relation let work be skipped (after Wang, Qin, Lin,
Zhang and Chang: Leveraging Set Relations in Exact Set Similarity Join, 2017):

* An index list is cut into blocks by the size of the sets and the position of the shared shingle in them. From the bounds of
  two blocks follows how large an overlap of their members can be at most; blocks that can't reach the threshold with
  each other are skipped whole, and then pairs one by one by the same rule (``components.open_pairs``).
* Answers are derived from those of highly similar sets: equal sets are one entry of the index; sets that are linked to the same
  set need no comparison with each other; and the size of the symmetric difference is a metric, so what was measured
  between a list's first set and two others bounds, and often decides, the answer of these two (``components.link_lists``).

A pair that is left is compared by parity bitmaps, whose differing bits are a lower bound of the symmetric difference,
and then by the sets themselves. Shingles are 64-bit hashes; equal sets are found by their size and 128 bits more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RID, Workspace, by_bytes, mix, shuffle_partitions, utf8, with_rid
from tidemark.llm.components import link_lists
from tidemark.llm.shingles import shingle_sets

WORDS, PERCENT = 4, 85
#: Shingles are ordered by how often the bucket of their hash occurs in the corpus: so many bits of the hash, a byte for each
#: bucket, whatever the corpus. Any order gives the same links; one that has rare shingles first gives short lists.
BUCKET_BITS = 24
BITS = 1024
#: Beyond so many documents to be compared, they are joined by a shuffle and not by a broadcast of their numbers.
BROADCAST_ROWS = 2_000_000


def needed(x: Column, y: Column, percent: int) -> Column:
    """The least overlap of sets of these sizes with the similarity: o >= p (x + y) / (100 + p)."""
    return F.ceil((x + y) * percent / (100 + percent)).cast("long")


#: Text worked on at once in a task.
SLICE_BYTES = 4 << 20


def _sets(batches, k: int):
    for batch in batches:
        rids = batch.column("rid").to_numpy()
        for lo, hi in by_bytes(batch.column("text"), SLICE_BYTES):
            yield rids[lo:hi], shingle_sets(*utf8(batch.column("text")[lo:hi]), k)


def _features(k: int):
    """Size, 128 bits that tell sets apart, and the parity bitmap."""
    one, two = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93)

    def run(batches):
        for rids, sets in _sets(batches, k):
            n, f, g, bits = [], [], [], []
            for s in sets:
                n.append(len(s))
                f.append(mix(s ^ one).sum(dtype=np.uint64))
                g.append(mix(s ^ two).sum(dtype=np.uint64))
                parity = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                bits.append(np.packbits(parity.astype(bool)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(n, pa.int64()), pa.array(np.array(f, np.uint64).view(np.int64)), pa.array(np.array(g, np.uint64).view(np.int64)), pa.array(bits, pa.binary())], names=["rid", "n", "f", "g", "bits"])

    return run


def _edge(part: int, parts: int, bits: int) -> int:
    """The first bucket of a range of buckets."""
    return -(-(part << bits) // parts)


def _tallies(k: int, parts: int, bits: int):
    """For each range of buckets: those of the shingles in this batch, and counts where more than one."""
    shift = np.uint64(64 - bits)

    def run(batches):
        for _, sets in _sets(batches, k):
            held = list(sets)
            token, count = np.unique((np.concatenate(held) >> shift).astype(np.uint32) if held else np.zeros(0, np.uint32), return_counts=True)
            if not len(token):
                continue
            part = (token.astype(np.uint64) * np.uint64(parts) >> np.uint64(bits)).astype(np.int32)
            edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            rows = []
            for a, b in zip(edge, np.r_[edge[1:], len(token)]):
                more = np.flatnonzero(count[a:b] > 1)
                extra = np.stack([token[a:b][more], (count[a:b][more] - 1).astype(np.uint32)])
                rows.append((int(part[a]), token[a:b].tobytes(), extra.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "tokens", "more"])

    return run


def _levels(parts: int, bits: int):
    """The levels of the buckets of each range: the logarithm of the count, in quarters of a doubling."""

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, tokens, more in zip(batch.column("part").to_pylist(), batch.column("tokens"), batch.column("more")):
                lo, tokens, more = _edge(part, parts, bits), tokens.as_buffer(), more.as_buffer()
                held = counts.setdefault(part, np.zeros(_edge(part + 1, parts, bits) - lo, np.int64))
                extra = np.frombuffer(more, np.uint32).reshape(2, -1)
                held[np.frombuffer(tokens, np.uint32) - lo] += 1  # each bucket once in a row
                held[extra[0] - lo] += extra[1]
        for part, held in counts.items():
            level = np.round(4 * np.log2(1 + held)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level], pa.binary())], names=["part", "levels"])

    return run


def frequency_levels(texts: DataFrame, k: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """The level of each bucket of shingles, from counts over all documents. The driver gets a byte for each bucket.

    Each task counts its own batches before anything is shuffled; what is collected has a fixed size.
    """
    parts = shuffle_partitions(texts.sparkSession)
    rows = texts.mapInArrow(_tallies(k, parts, bits), "part int, tokens binary, more binary").repartition(parts, "part")
    levels = np.zeros(1 << bits, np.uint8)
    for row in rows.mapInArrow(_levels(parts, bits), "part int, levels binary").collect():
        lo = _edge(row.part, parts, bits)
        levels[lo : lo + len(row.levels)] = np.frombuffer(row.levels, np.uint8)
    return levels


def _postings(k: int, percent: int, levels, bits: int):
    """Entries of the index: shingle, position, size, the set's own hash and the document, of each set's prefix."""
    one = np.uint64(0x8CB92BA72F3D8DD7)

    def run(batches):
        level = levels.value
        for rids, sets in _sets(batches, k):
            held = {}
            for rid, s in zip(rids.tolist(), sets):
                n = len(s)
                if not n:
                    continue
                own = int(mix(s ^ one).sum(dtype=np.uint64).view(np.int64))
                if (n, own) in held and held[n, own][0] <= rid:
                    continue  # an equal set of this batch stands for it
                prefix = n - -(-n * percent // 100) + 1
                order = np.argsort(level[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
                held[n, own] = (rid, s[order[:prefix]])
            if not held:
                continue
            sizes = np.array([len(p) for _, p in held.values()])
            each = lambda values: np.repeat(np.fromiter(values, np.int64, len(held)), sizes)
            pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [np.concatenate([p for _, p in held.values()]).view(np.int64), pos, each(n for n, _ in held), each(o for _, o in held), each(r for r, _ in held.values())]
            for s in range(0, len(pos), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + (1 << 16)]) for c in columns], names=["list", "pos", "n", "own", "rid"])

    return run


def _lists(batches):
    """Of entries sorted by list, position, size, set and document: those of lists with more than one set, with the first.

    Copies of a set stand together and only the first of them stays. The state is one entry, however long a list is.
    """
    names = ["list", "pos", "n", "own", "rid"]
    # Of the list that the last batch ended in: its first entry, its last one, and whether there were several.
    hub, last, told = None, None, False
    for batch in batches:
        c = {k: batch.column(k).to_numpy() for k in names}
        if not len(c["list"]):
            continue
        if last is not None:
            c = {k: np.r_[last[k], c[k]] for k in names}
        copy = np.zeros(len(c["list"]), bool)
        copy[1:] = (c["list"][1:] == c["list"][:-1]) & (c["n"][1:] == c["n"][:-1]) & (c["own"][1:] == c["own"][:-1])
        c = {k: v[~copy] for k, v in c.items()}
        new = np.r_[True, c["list"][1:] != c["list"][:-1]]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        first = {k: c[k][begin] for k in ("rid", "n", "pos")}
        size = np.diff(np.r_[np.flatnonzero(new), len(new)])
        several = np.repeat(size > 1, size)
        out = several.copy()
        if last is not None:  # the first run goes on with the list of the batch before, from its last entry
            for k in first:
                first[k][: size[0]] = hub[k]
            if told:
                several[: size[0]], out[: size[0]], out[0] = True, True, False
        hub, last, told = {k: first[k][-1] for k in first}, {k: v[-1:] for k, v in c.items()}, bool(several[-1])
        if out.any():
            cols = [c["list"], c["rid"], c["n"], c["pos"], first["rid"], first["n"], first["pos"]]
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in cols], names=["list", "rid", "n", "pos", "hub", "hub_n", "hub_pos"])


def _set_blobs(k: int):
    def run(batches):
        for rids, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "items"])

    return run


def _near_bits(percent: int):
    """Of each pair, how many bits of the bitmaps differ, and whether that leaves the similarity possible."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.stack([np.frombuffer(b, np.uint8) for b in batch.column(c).to_pylist()]) for c in ("bits_a", "bits_b"))
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            close = differ <= both - 2 * -(-both * percent // (100 + percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(differ), pa.array(close)], names=["a", "b", "low", "close"])

    return run


def _similar(percent: int):
    """The size of each pair's symmetric difference, as its lower and upper bound, and whether the sets are similar."""

    def run(batches):
        for batch in batches:
            apart, link = [], []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                apart.append(len(x) + len(y) - 2 * common)
                link.append(100 * common >= percent * (len(x) + len(y) - common))
            apart = pa.array(apart, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), apart, apart, pa.array(link, pa.bool_())], names=["a", "b", "low", "high", "link"])

    return run


def _fetch(texts: DataFrame, pairs: DataFrame, k: int, ws: Workspace, tag: str) -> DataFrame:
    """(rid, items) for the documents in ``pairs``, from their texts."""
    wanted = ws.table(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct(), f"wanted-{tag}")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return ws.table(texts.join(side, "rid", "left_semi").mapInArrow(_set_blobs(k), "rid long, items binary"), f"sets-{tag}")


def _join_ends(pairs: DataFrame, values: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(values.select(F.col("rid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in values.columns if c != "rid"]), end)
    return pairs


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """(id, n_shingles, component_id) per row: components of the links between sets with 100 |x & y| >= percent |x | y|.

    A set has the distinct shingles of ``words`` words (A to Z lower-cased), or the whole sequence where there are fewer;
    a null text or one without words has the empty set, which links with nothing. component_id is the smallest id
    that links reach. Rows with a repeated id are documents of their own; a null id counts as larger than any other.
    Other columns are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    rows, is_id = with_rid(docs, id_col, ws, text_col)
    texts = rows.select(F.col(RID).alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    features = ws.table(texts.mapInArrow(_features(words), "rid long, n long, f long, g long, bits binary"), "features")
    levels = spark.sparkContext.broadcast(frequency_levels(texts, words, bucket_bits))
    postings = texts.mapInArrow(_postings(words, percent, levels, bucket_bits), "list long, pos long, n long, own long, rid long")
    ordered = postings.repartition(shuffle_partitions(spark), "list").sortWithinPartitions("list", "pos", "n", "own", "rid")
    entries = ws.table(ordered.mapInArrow(_lists, "list long, rid long, n long, pos long, hub long, hub_n long, hub_pos long"), "entries")
    bitmaps = features.select("rid", "n", "bits")

    def reach(n, pos):
        # The shared shingle and what follows it is the most that a set can share with another: the largest size for which that is enough.
        return F.expr(f"({n} - {pos}) * {100 + percent} div {percent} - {n}").alias(n.removesuffix("n") + "reach")

    entries = entries.select("list", "rid", "n", reach("n", "pos"), "hub", "hub_n", reach("hub_n", "hub_pos"))

    def room(x, y):
        return x("n") + y("n") - 2 * needed(x("n"), y("n"), percent)

    def may(x, y):
        return (x("n") <= y("reach")) & (y("n") <= x("reach"))

    def can(x, y):
        return (x("lo_n") <= y("hi_reach")) & (y("lo_n") <= x("hi_reach"))

    def measure(pairs: DataFrame, tag: str) -> DataFrame:
        told = ws.table(_join_ends(pairs, bitmaps).mapInArrow(_near_bits(percent), "a long, b long, low long, close boolean"), f"bits-{tag}")
        close = told.where("close").select("a", "b")
        exact = _join_ends(close, _fetch(texts, close, words, ws, tag)).select("a", "b", "items_a", "items_b")
        exact = exact.mapInArrow(_similar(percent), "a long, b long, low long, high long, link boolean")
        return exact.unionByName(told.where("not close").select("a", "b", "low", F.lit(None).cast("long").alias("high"), F.lit(False).alias("link")))

    linked = link_lists(entries, percent / 100, room, may, can, measure, ws)
    # Equal sets: the first row stands for all.
    classes = ws.table(features.where("n > 0").groupBy("n", "f", "g").agg(F.min("rid").alias("first")), "classes")
    member = features.select("rid", "n", "f", "g").join(classes, ["n", "f", "g"], "left").select("rid", "n", F.coalesce("first", "rid").alias("first"))
    out = member.join(linked.select(F.col("node").alias("first"), "component"), "first", "left").select("rid", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"))
    if is_id:
        return out.withColumnRenamed("rid", id_col)
    out = ws.table(out.join(rows.select(F.col(RID).alias("rid"), F.col(id_col)), "rid"), "named-rows")
    least = out.groupBy("component_id").agg(F.min(id_col).alias("least"))
    return out.join(least, "component_id").select(id_col, "n_shingles", F.col("least").alias("component_id"))
