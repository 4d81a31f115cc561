"""Removal of long repeated byte strings, by a sparse suffix array in range-partitioned buckets.

A byte goes if it is covered by a string of ``LENGTH`` bytes that starts anywhere else too. Suffixes are taken at anchors
only: of the places in a window of LENGTH bytes where a string of ``LEAD`` bytes starts, the one with the least hash (the
first of equals). Equal windows have the same anchor, so two equal windows are found by two suffixes that begin with the
same leading bytes; about one place in 137 is an anchor.

1. Each anchor has a stretch: the bytes of all windows it is the anchor of. Suffixes are counted by their leading bytes; those
   that stand alone are done with. Where stretches are equal as a whole (copies), all their windows are repeated.
2. What is left are suffixes with equal leading bytes and different stretches, one for each different stretch. Sampled splitters
   range-partition them by their leading bytes, up to LENGTH of them, so a lead that very many share is split as well.
3. Each bucket sorts its suffixes, and then the windows of suffixes that share a lead, by multikey quicksort: by eight bytes
   at a time, only what is equal so far going on to the next eight. Windows that stay together to the end are repeated.
4. Buckets are compared across their boundaries: a window whose part from the anchor on is also that of the bucket's first
   or last suffix may have an equal one in another bucket. The stretches of such windows are dealt once more, by what is before
   the anchor, and sorted in the same way. Windows that agree with an edge of their bucket there too are counted by 128-bit
   fingerprints, one for each different window of a bucket.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RID, Workspace, shuffle_partitions, utf8, with_rid

LENGTH, LEAD = 400, 128
#: About so many bytes of stretches go into a bucket.
BUCKET_BYTES = 8 << 20
#: Copies of stretches with more occurrences are found without a shuffle by their stretch, as far as so many are broadcast.
HOT, HOT_STRETCHES = 256, 200_000
#: Bytes worked on at once; places within them are told apart by this many bits.
SLICE_BYTES, PLACE_BITS = 1 << 20, 22

_rng = np.random.default_rng(7_654_321)
_TABLES = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_STEPS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_MIXERS = (_rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).reshape(8, 2)
_powers: dict = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) <= n:
        size = max(n + 1, SLICE_BYTES + 2 * LENGTH)
        step = _STEPS[which]
        make = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(x))], dtype=np.uint64)
        with np.errstate(over="ignore"):
            _powers[which] = make(step), make(pow(step, -1, 1 << 64))
    return _powers[which]


def fingerprints(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit polynomial hashes of each data[begin:end], functions of the bytes alone."""
    out = []
    with np.errstate(over="ignore"):
        for which in range(2):
            up, down = _power(which, len(data))
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_TABLES[which][data] * up[: len(data)], out=total[1:])
            out.append((total[end] - total[begin]) * down[begin])
    return out[0], out[1]


def _lead_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the LEAD bytes from each place, by doubling: of 8 bytes, of 16, and so on."""
    h, width, level = data.astype(np.uint64), 1, 0
    with np.errstate(over="ignore"):
        while width < LEAD:
            if width < 8:
                h = h[:-width] | (h[width:] << np.uint64(8 * width))
            else:
                h = h[:-width] * _MIXERS[level, 0] + h[width:] * _MIXERS[level, 1]
                h ^= h >> np.uint64(31)
            width, level = 2 * width, level + 1
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, at: np.ndarray):
    """(text, place, first window, last window, hash of the lead, two fingerprints of the stretch), as arrays.

    ``at`` has the places where the texts begin, and their end. Windows lie within texts.
    """
    wide = LENGTH - LEAD + 1
    n = len(data) - LENGTH + 1
    sizes = np.diff(at) - LENGTH + 1  # windows of each text
    if n <= 0 or not (sizes > 0).any():
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 3
    lead = _lead_hashes(data)
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (lead & ~low) | np.arange(len(lead), dtype=np.uint64)
    rows = -(-len(key) // wide)
    grid = np.full(rows * wide, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(rows, wide)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(after[:n], before[wide - 1 : wide - 1 + n]) & low).astype(np.int64)
    has = sizes > 0
    step = np.zeros(n + 1, np.int8)
    np.add.at(step, at[:-1][has], 1)
    np.add.at(step, at[:-1][has] + sizes[has], -1)
    good = np.cumsum(step[:n]) > 0
    begin = good.copy()
    begin[1:] &= (place[1:] != place[:-1]) | ~good[:-1]
    begin[at[:-1][has]] = True  # adjacent texts never share an anchor's row
    first = np.flatnonzero(begin)
    # The last window of a stretch is the one before the next stretch, or the text's last.
    text = np.searchsorted(at, first, side="right") - 1
    last = np.minimum(np.r_[first[1:], n] - 1, at[text] + sizes[text] - 1)
    spot = place[first]
    f, g = fingerprints(data, first, last + LENGTH)
    return [text, spot - at[text], first - at[text], last - at[text], lead[spot], f, g]


def _parts(at: np.ndarray):
    """(first text, last text + 1, byte from, byte to) of slices; a long text is cut so that each window is in one slice."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, side="right")) - 1)
        hi = min(hi, n)
        if hi == lo + 1 and at[hi] - at[lo] > SLICE_BYTES:
            for s in range(int(at[lo]), int(at[hi]), SLICE_BYTES):
                yield lo, hi, s, min(s + SLICE_BYTES + LENGTH - 1, int(at[hi]))
        else:
            yield lo, hi, int(at[lo]), int(at[hi])
        lo = hi


def _anchor_rows(batches):
    names = ["lead", "f", "g", "rid", "place", "lo", "hi"]
    for batch in batches:
        data, at = utf8(batch.column("text"))
        rid = batch.column("rid").to_numpy()
        for a, b, s, e in _parts(at):
            whole = at[a] == s and at[b] == e
            text, place, lo, hi, lead, f, g = anchors(data[s:e], at[a : b + 1] - s if whole else np.array([0, e - s]))
            back = 0 if whole else s - at[a]
            columns = [lead.view(np.int64), f.view(np.int64), g.view(np.int64), rid[a + text], place + back, lo + back, hi + back]
            if len(text):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _stretches(batches):
    """The bytes of the wanted stretches of each text, and where in them the anchor is."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    for batch in batches:
        for rid, text, wanted in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            data = text.encode()
            rows = [(rid, w["lo"], w["place"] - w["lo"], w["alone"], data[w["lo"] : w["hi"] + LENGTH]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["rid", "lo", "anchor", "alone", "data"])


def multikey(words: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, group) of the strings of ``length`` bytes that equal another one of their group, sorted by group and contents.

    Multikey quicksort with eight bytes as a character: ``words`` has the eight bytes from each place on as a number. Parts of equal
    characters go on to the next one; a part of one string is done.
    """
    index = np.argsort(group, kind="stable")
    group = group[index]
    for depth in range(0, length + 8, 8):
        new = np.r_[True, group[1:] != group[:-1]][: len(group)]
        several = ~(new & np.r_[new[1:], True][: len(new)])
        index, new = index[several], new[several]
        part = np.cumsum(new) - 1
        if depth >= length or not len(index):
            return index, part
        char = words[start[index] + depth]
        differs = np.zeros(part[-1] + 1, bool)
        differs[part[char != char[np.flatnonzero(new)][part]]] = True
        sort = np.flatnonzero(differs[part])
        order = np.lexsort((char[sort], part[sort]))
        index[sort], char[sort] = index[sort][order], char[sort][order]
        group = np.cumsum(np.r_[True, (part[1:] != part[:-1]) | (char[1:] != char[:-1])])
    return index, group


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; what is beyond the end is zero."""
    words = np.zeros(len(data) + LENGTH, np.uint64)
    padded = np.r_[data, np.zeros(LENGTH + 8, np.uint8)].astype(np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)] << np.uint64(56 - 8 * k)
    return words


def _common(data: np.ndarray, begin: np.ndarray, size: np.ndarray, other: bytes, step: int = 1) -> np.ndarray:
    """How many of the ``size`` bytes at begin, begin + step and so on are those of ``other``, up to the first that isn't."""
    out = np.zeros(len(begin), np.int64)
    live = np.arange(len(begin))
    for k, c in enumerate(other):
        live = live[size[live] > k]
        live = live[data[begin[live] + k * step] == c]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _windows(at: np.ndarray, chosen: np.ndarray):
    """(stretch, window within it) of all windows of the chosen stretches."""
    sizes = at[chosen + 1] - at[chosen] - LENGTH + 1
    which = np.repeat(chosen, sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


_STRETCH = pa.schema([("rid", pa.int64()), ("lo", pa.int64()), ("anchor", pa.int32()), ("alone", pa.bool_()), ("data", pa.binary())])
_EDGE = pa.schema([*_STRETCH, ("near", pa.int64()), ("back", pa.binary())])
_FIRST = pa.schema([("s", pa.int64()), ("e", pa.int64()), *_EDGE])
_SECOND = pa.schema([("rid", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("alone", pa.bool_()), ("f", pa.int64()), ("g", pa.int64())])


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of these columns, null in the others."""
    n = len(columns["rid"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


class _Bucket:
    """The stretches of one bucket, in memory."""

    def __init__(self, batches, schema: pa.Schema):
        held = [b.select(schema.names) for b in batches if b.num_rows]
        self.table = pa.Table.from_batches(held) if held else schema.empty_table()
        self.rid, self.lo, self.anchor, self.alone = (self.table[c].to_numpy() for c in ("rid", "lo", "anchor", "alone"))
        self.data, self.at = utf8(self.table["data"])
        self.begin = self.at[:-1] + self.anchor

    def slices(self, chosen: np.ndarray, part: np.ndarray):
        """The windows (stretch, window within it, part) of the chosen stretches, by parts of about SLICE_BYTES; a part of ``part`` stays whole."""
        total = np.cumsum(self.at[chosen + 1] - self.at[chosen])
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
        ends, k = np.r_[starts[1:], len(part)], 0
        while k < len(starts):
            before = total[starts[k] - 1] if starts[k] else 0
            stop = max(k + 1, int(np.searchsorted(total[ends - 1], before + SLICE_BYTES, side="right")))
            mine = slice(starts[k], ends[stop - 1])
            which, inside = _windows(self.at, chosen[mine])
            yield which, inside, np.repeat(part[mine], self.at[chosen[mine] + 1] - self.at[chosen[mine]] - LENGTH + 1)
            k = stop

    def repeated(self, schema: pa.Schema):
        """Runs of repeated windows of stretches that stand alone; suffixes that share their lead are sorted together."""
        words = _words(self.data)
        for which, inside, lead in self.slices(*multikey(words, self.begin, np.zeros(len(self.begin), np.int64), LEAD)):
            # Equal windows have their anchors at the same place, so only such windows are sorted together.
            same, _ = multikey(words, self.at[which] + inside, lead * 2 * LENGTH + self.anchor[which] - inside + LENGTH, LENGTH)
            twice = np.zeros(len(which), bool)
            twice[same] = True
            twice &= self.alone[which]
            first, last = twice.copy(), twice.copy()
            first[1:] &= ~(twice[:-1] & (which[1:] == which[:-1]))
            last[:-1] &= ~(twice[1:] & (which[1:] == which[:-1]))
            first, last = np.flatnonzero(first), np.flatnonzero(last)
            if len(first):
                yield _batch(schema, rid=self.rid[which[first]], s=self.lo[which[first]] + inside[first], e=self.lo[which[last]] + inside[last] + LENGTH)


def _forward(batches):
    """Repeated windows of a bucket of suffixes, and the stretches that reach its edges with how far they agree with these."""
    bucket = _Bucket(batches, _STRETCH)
    if not len(bucket.rid):
        return
    yield from bucket.repeated(_FIRST)
    texts, anchor = bucket.table["data"].to_pylist(), bucket.anchor.tolist()
    edges = [f(d[a:] for d, a in zip(texts, anchor)) for f in (min, max)]
    near = np.maximum(*(_common(bucket.data, bucket.begin, bucket.at[1:] - bucket.begin, e) for e in edges))
    # Of a stretch's windows, the first has the shortest part from the anchor on.
    reach = np.flatnonzero(near >= LENGTH - bucket.anchor)
    if len(reach):
        columns = {"rid": bucket.rid, "lo": bucket.lo, "anchor": bucket.anchor, "alone": bucket.alone, "near": near}
        ends = {"data": [texts[k] for k in reach], "back": [texts[k][: anchor[k]][::-1] for k in reach]}
        yield _batch(_FIRST, **{c: v[reach] for c, v in columns.items()}, **ends)


def _backward(batches):
    """The same for stretches dealt by what is before the anchor; and fingerprints of the windows that reach the edges of both buckets."""
    bucket = _Bucket(batches, _EDGE)
    if not len(bucket.rid):
        return
    yield from bucket.repeated(_SECOND)
    backs, near = bucket.table["back"].to_pylist(), bucket.table["near"].to_numpy()
    size = bucket.anchor.astype(np.int64)
    behind = np.maximum(*(_common(bucket.data, bucket.begin - 1, size, e, -1) for e in (min(backs), max(backs))))
    found = []
    for which, inside, _ in bucket.slices(np.arange(len(backs)), np.arange(len(backs))):
        before = bucket.anchor[which] - inside  # negative if the window begins after the anchor
        open_ = np.flatnonzero((before <= behind[which]) & (LENGTH - before <= near[which]))
        if len(open_):
            base, end = int(bucket.at[which[0]]), int(bucket.at[which[-1] + 1])
            s = bucket.at[which[open_]] + inside[open_] - base
            f, g = fingerprints(bucket.data[base:end], s, s + LENGTH)
            found.append((f, g, bucket.rid[which[open_]], bucket.lo[which[open_]] + inside[open_], bucket.alone[which[open_]]))
    if found:
        f, g, rid, s, alone = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((g, f))
        f, g, rid, s, alone = (c[order] for c in (f, g, rid, s, alone))
        new = np.r_[True, (f[1:] != f[:-1]) | (g[1:] != g[:-1])]
        several = ~np.r_[new[1:], True][new]  # repeated within the bucket, which is known already
        yield _batch(_SECOND, rid=rid[new], s=s[new], alone=alone[new] & ~several, f=f[new].view(np.int64), g=g[new].view(np.int64))


def _removed(batches):
    names = ["rid", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        rows = []
        for rid, text, spans in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "spans"))):
            data, kept, end, runs = text.encode(), [], -1, 0
            for x in spans or ():
                if x["s"] > end:  # touching spans are one run
                    kept.append(data[max(end, 0) : x["s"]])
                    runs += 1
                end = max(end, x["e"])
            kept.append(data[max(end, 0) :])
            rows.append((rid, len(data), len(data) - sum(map(len, kept)), runs, sha256(b"".join(kept)).hexdigest()))
        if rows:
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def repeated_spans(texts: DataFrame, ws: Workspace, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(rid, s, e): stretches of bytes whose windows are all repeated, overlapping and in no order."""
    found = ws.table(texts.mapInArrow(_anchor_rows, "lead long, f long, g long, rid long, place long, lo long, hi long"), "anchors")
    more = (F.min("f") != F.max("f")) | (F.min("g") != F.max("g"))
    leads = ws.table(found.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), more.alias("several")).where("n > 1").drop("n"), "leads")
    shared = ws.table(found.join(leads, "lead"), "shared")
    ws.drop("anchors", "leads")
    one = F.min(F.struct("rid", "lo", "hi", "place")).alias("one")
    groups = ws.table(shared.groupBy("lead", "f", "g", "several").agg(F.count(F.lit(1)).alias("n"), one), "groups")
    key, span = ["lead", "f", "g"], ["rid", F.col("lo").alias("s"), (F.col("hi") + LENGTH).alias("e")]
    hot = groups.where(F.col("n") > HOT).select(*key)
    if hot.count() <= HOT_STRETCHES:
        hot, rest = F.broadcast(hot), groups.where(F.col("n").between(2, HOT)).select(*key)
        copies = shared.join(hot, key, "left_semi").select(*span).unionByName(shared.join(hot, key, "left_anti").join(rest, key).select(*span))
    else:
        copies = shared.join(groups.where("n > 1").select(*key), key).select(*span)
    # One stretch for each different one, where a lead has several.
    open_ = groups.where("several").select("lead", "one.*", (F.col("n") == 1).alias("alone"))
    wanted = open_.groupBy("rid").agg(F.collect_list(F.struct("place", "lo", "hi", "alone")).alias("wanted"), F.sum(F.col("hi") - F.col("lo") + LENGTH).alias("size"))
    wanted = ws.table(wanted, "wanted")
    stretches = texts.join(wanted.drop("size"), "rid").select("rid", "text", "wanted").mapInArrow(_stretches, "rid long, lo long, anchor int, alone boolean, data binary")
    stretches = ws.table(stretches, "stretches")
    buckets = max(shuffle_partitions(texts.sparkSession), (wanted.agg(F.sum("size")).first()[0] or 0) // bucket_bytes + 1)
    # The rest of the key tells equal suffixes apart, so that however many there are, they are split too.
    suffix, tie = F.substring("data", F.col("anchor") + 1, F.lit(LENGTH)), ["rid", "lo"]
    near = stretches.repartitionByRange(buckets, suffix, *tie).mapInArrow(_forward, "s long, e long, rid long, lo long, anchor int, alone boolean, data binary, near long, back binary")
    near = ws.table(near, "near")
    edge = near.where("data is not null").select("rid", "lo", "anchor", "alone", "data", "near", "back")
    again = (edge.agg(F.sum(F.length("data"))).first()[0] or 0) // bucket_bytes + 1
    far = ws.table(edge.repartitionByRange(again, "back", *tie).mapInArrow(_backward, "rid long, s long, e long, alone boolean, f long, g long"), "far")
    twice = far.where("f is not null").groupBy("f", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f", "g")
    across = far.where("alone").join(twice, ["f", "g"], "left_semi").select("rid", "s", (F.col("s") + LENGTH).alias("e"))
    for found in (near.where("data is null"), far.where("f is null"), across):
        copies = copies.unionByName(found.select("rid", "s", "e"))
    return copies


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, changed) per row: what is left without the repeated strings of LENGTH bytes.

    Bytes are those of the text in UTF-8; a null text counts as empty, and texts shorter than LENGTH keep all. Strings are
    judged on the input; ``changed`` says whether any was removed. Rows with a repeated or null id are texts of their own, so repeated rows repeat each other. Other
    columns are not read.
    """
    ws = Workspace(docs.sparkSession, "substrings")
    rows, is_id = with_rid(docs, id_col, ws, text_col)
    texts = rows.select(F.col(RID).alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(texts, ws, bucket_bytes)
    spans = ws.table(spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")), "spans")
    ws.drop("shared", "groups", "wanted", "stretches", "near", "far")
    out = texts.join(spans, "rid", "left").mapInArrow(_removed, "rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = out.withColumn("changed", F.col("n_removed") > 0)
    if is_id:
        return out.withColumnRenamed("rid", id_col)
    return out.join(rows.select(F.col(RID).alias("rid"), F.col(id_col)), "rid").select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "changed")
