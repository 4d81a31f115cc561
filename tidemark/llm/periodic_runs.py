"""Runs of periodically repeated words in each text, by Karp-Miller-Rosenberg naming.

The words of a document get integer names, and names of stretches of 2, 4, 8, ... words are made by naming pairs of names
(sorting integer pairs; names are compared contents, never hashes). A run of period q has at least four periods here, so it
covers three neighbouring points of the grid 0, q, 2q, ...: the stretch of q words at the first equals that at the second
and so on, which two names of the level below q tell for all points of the grid at once. The first point of such a chain is
extended both ways by descending the levels of names (the longest common extension), and that is the run. A document drops
out of the levels as soon as no stretch of a level occurs twice in it.

Documents of one Arrow batch are worked on together, in slices of about ``SLICE_BYTES``. There is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.llm.common import by_bytes, utf8

SLICE_BYTES = 1 << 20
#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Level:
    """Names of all stretches of ``width`` words of the documents that are still of interest, one after the other.

    ``base[d]`` is where document d begins, or -1. Names of different documents differ, and grow with the document's place.
    """

    def __init__(self, width: int, names: np.ndarray, docs: np.ndarray, counts: np.ndarray, n_docs: int):
        self.width, self.names, self.docs = width, names, docs
        self.begins = np.concatenate([[0], np.cumsum(counts)])
        self.base = np.full(n_docs, -1, np.int64)
        self.base[docs] = self.begins[:-1]

    def repeating(self) -> np.ndarray:
        """Places in ``docs`` of those in which a stretch occurs twice."""
        if not len(self.docs):
            return np.zeros(0, np.int64)
        most, least = np.maximum.reduceat(self.names, self.begins[:-1]), np.minimum.reduceat(self.names, self.begins[:-1])
        return np.flatnonzero(most - least + 1 < np.diff(self.begins))


def _named(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int32)


def _levels(words: np.ndarray, sizes: np.ndarray) -> list[_Level]:
    """Levels of names; documents are put in falling order of their number of words."""
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST_WORDS]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    counts = sizes[order]
    at = np.repeat(offsets[order] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(order) else np.zeros(0, np.int64)
    rank = np.repeat(np.arange(len(order), dtype=np.int64), counts)
    found = [_Level(1, _named(rank * (int(words.max(initial=0)) + 1) + words[at]), order, counts, len(sizes))]
    while True:
        level = found[-1]
        width = 2 * level.width
        stay = level.repeating()
        stay = stay[sizes[level.docs[stay]] >= LEAST_PERIODS * width]
        if not len(stay):
            return found
        docs, begins = level.docs[stay], level.begins[stay]
        counts = sizes[docs] - width + 1
        left = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        pairs = level.names[left].astype(np.int64) * (int(level.names.max()) + 1) + level.names[left + level.width]
        found.append(_Level(width, _named(pairs), docs, counts, len(sizes)))


def _extent(levels: list[_Level], sizes: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many words from i and j on are the same (step 1), or before i and j (step -1); i < j."""
    same = np.zeros(len(doc), np.int64)
    for level in reversed(levels):
        w, base = level.width, level.base[doc]
        going = np.flatnonzero(base >= 0)
        while len(going):
            a, b = (i[going] + same[going], j[going] + same[going]) if step > 0 else (i[going] - same[going] - w, j[going] - same[going] - w)
            inside = (b + w <= sizes[doc[going]]) if step > 0 else (a >= 0)
            going, a, b = going[inside], a[inside], b[inside]
            equal = level.names[base[going] + a] == level.names[base[going] + b]
            going = going[equal]
            same[going] += w
    return same


def find_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, sorted by document, start and period.

    ``words`` holds the word numbers of documents of these ``sizes``, one after the other.
    """
    levels, found = _levels(words, sizes), []
    for level in levels:
        w, ns = level.width, sizes[level.docs]
        for q in range(w, min(2 * w - 1, int(ns[0]) // LEAST_PERIODS if len(ns) else 0) + 1):
            # Documents are in falling order of size: those with room for four periods come first.
            names = level.names[: level.begins[np.searchsorted(-ns, -LEAST_PERIODS * q, side="right")]]
            head = names[::q]
            same = head[1:] == head[:-1]
            if not same.any():
                continue
            tail = names[q - w :: q]
            other = tail[1:] == tail[:-1]
            whole = same[: len(other)] & other[: len(same)]
            first = whole[:-1] & whole[1:]
            first[1:] &= ~whole[:-2]
            points = np.flatnonzero(first) * q
            if len(points):
                place = np.searchsorted(level.begins, points, side="right") - 1
                doc, at = level.docs[place], points - level.begins[place]
                begin = at - _extent(levels, sizes, doc, at, at + q, -1)
                end = at + q + _extent(levels, sizes, doc, at, at + q, 1)
                found.append(np.stack([doc, begin, end - begin, np.full(len(doc), q)], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[rows[:, 2] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * rows[:, 3])]
    # A multiple of the smallest period gives the same stretch again; the smallest one counts.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, their numbers, and how many each document has. Equal words have equal numbers."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before, after = np.concatenate([[False], inside[:-1]]) if len(data) else inside, np.concatenate([inside[1:], [False]]) if len(data) else inside
    begins, ends = np.flatnonzero(inside & (~before | cut[:-1])), np.flatnonzero(inside & (~after | cut[1:])) + 1
    lengths = np.concatenate([[0], np.cumsum(ends - begins)])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(data[inside])])
    numbers = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return begins, ends, numbers, np.diff(np.searchsorted(begins, at))


def _joined(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, kept: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
    lengths = ends[kept] - begins[kept] + 1
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    source = np.repeat(begins[kept] - (stops - lengths), lengths) + np.arange(total)
    out = np.append(data, np.uint8(0x20))[source]
    out[stops - 1] = 0x20
    # The space after a document's last word goes.
    last = np.cumsum(counts)[counts > 0] - 1
    keep = np.ones(total, bool)
    keep[stops[last] - 1] = False
    words = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
    offsets = words - np.concatenate([[0], np.cumsum(counts > 0)])
    made = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep]))
    return made.cast(pa.string())


def _scan(slice_bytes: int):
    def scan(batches):
        for batch in batches:
            for start, stop in by_bytes(batch.column(1), slice_bytes):
                part = batch.slice(start, stop - start)
                data, at = utf8(part.column(1))
                begins, ends, numbers, sizes = _words(data, at)
                rows = find_runs(numbers, sizes)
                doc, begin, length, period = rows.T
                here = np.concatenate([[0], np.cumsum(sizes)])[doc] + begin
                change = np.bincount(here + period, minlength=len(begins) + 1) - np.bincount(here + length, minlength=len(begins) + 1)
                kept = np.cumsum(change[:-1]) == 0 if len(begins) else np.zeros(0, bool)
                places = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(sizes)))]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (begin, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(places), values), _joined(data, begins, ends, kept, sizes)], ["id", "runs", "collapsed"])

    return scan


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, runs, collapsed) for each row: every run of its words, by start and period, and the text without the repeats.

    Words are what white space (blank, characters 9 to 13) parts; they are compared byte by byte. A run is a stretch of
    words with smallest period q and at least ``max(6, 4 * q)`` words that can't be made longer at either end. ``collapsed``
    joins by one space the words that no run contains after its first q words. A null or blank text has no run and an empty
    ``collapsed``. Ids are passed through, whether null, repeated or not; other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    runs = StructType.fromDDL(f"runs {RUNS}")["runs"]
    schema = StructType([rows.schema["id"], runs, StructField("collapsed", StringType())])
    return rows.mapInArrow(_scan(slice_bytes), schema).withColumnRenamed("id", id_col)
