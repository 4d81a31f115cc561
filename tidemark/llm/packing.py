"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document's token ids are followed by a separator id, and documents longer than a sequence are cut. Lengths are whole
numbers up to the capacity, so the whole packing is planned on the histogram of lengths, which has as many entries
as the capacity whatever the size of the corpus:

1. Linear grouping: the large lengths, in falling order, are cut into groups of equal cardinality and rounded up to
   the largest of their group, which leaves few sizes.
2. Configurations of those sizes are found that fill a sequence best, each used as often as its sizes last.
3. The actual documents take the places of the rounded ones, which frees what the rounding added.
4. The small documents go best-fit into what is free, then into new sequences.

The plan says which rank interval of which length lies where. Ranks come from a distributed count: a number within
(task, length) from the tokenising pass plus the counts of the tasks before it.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import RID, Workspace, by_bytes, utf8, with_rid
from tidemark.llm.words import Ragged, WordNumbers, pieces_of

CAPACITY = 2048
SEPARATOR = 0
#: Slice of text worked on at once, and words remembered in a worker.
SLICE_BYTES, REMEMBERED = 4 << 20, 1_000_000


#: Byte-level alphabets give printable Latin-1 bytes as themselves and the others, in order, from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _PRINTABLE} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


class IdMaker:
    """Token ids of texts by a tokenizers file whose pre-tokeniser never joins text over ASCII white space.

    New words are encoded once in a worker. A word of letters alone is one pre-token, so it can skip the normaliser and
    the pre-tokeniser, which take most of the time: many such words are encoded as one text, and the model's mark of a
    word's end says where each one's ids end. That needs the pipeline of this kind of file; for any other all words take
    the slow way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(Path(path).read_text())
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        end = told["model"].get("end_of_word_suffix")
        self.fast = None
        if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and end and not told["post_processor"]:
            self.fast = Tokenizer(self.tokenizer.model)
            self.fast.pre_tokenizer = WhitespaceSplit()
            self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.is_end[[n for token, n in told["model"]["vocab"].items() if token.endswith(end)]] = True
            self.marks = {m: self._encode([m])[0] for m in (b",", b".")}
        self.words, self.ids = WordNumbers(), Ragged()

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    @staticmethod
    def _letters(word: bytes) -> str | None:
        """The word as its byte-level letters if it is one pre-token of lower-casable letters, else None."""
        if word.isalpha():
            return word.decode().lower()
        text = word.decode()
        low = text.lower()
        if not text.isalpha() or max(text) > "\u024f" or len(low) != len(text) or not is_normalized("NFC", text):
            return None
        return low.encode().decode("latin-1").translate(_ALPHABET)

    def _learn(self) -> None:
        fresh, self.words.fresh = self.words.fresh, []
        made: list = [None] * len(fresh)
        alone, slow = [], []
        for k, word in enumerate(fresh):
            mark = word[-1:] if self.fast and len(word) > 1 and word[-1:] in self.marks else b""
            letters = self._letters(word[:-1] if mark else word) if self.fast else None
            if letters is None:
                slow.append(k)
            else:
                alone.append((k, letters, self.marks.get(mark, [])))
        if alone:
            ids = np.array(self.fast.encode_batch_fast([" ".join(x for _, x, _ in alone)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(alone):
                raise ValueError("the tokeniser's words don't end where they should")
            for (k, _, mark), x in zip(alone, np.split(ids, ends[:-1])):
                made[k] = x.tolist() + mark
        for k, x in zip(slow, self._encode([fresh[k] for k in slow])):
            made[k] = x
        self.ids.extend(made)

    def __call__(self, text: bytes) -> np.ndarray:
        out = []
        for part in pieces_of(text, SLICE_BYTES):
            if len(self.words) > REMEMBERED:
                self.words, self.ids = WordNumbers(), Ragged()
            # The tokeniser lower-cases; for ASCII this can come first, which makes fewer words. Special tokens are matched before.
            numbers = self.words.of((part.lower() if part.isascii() and b"<|" not in part else part).split())
            if self.words.fresh:
                self._learn()
            out.append(self.ids.gather(numbers))
        return np.concatenate(out) if len(out) != 1 else out[0]


@lru_cache(maxsize=2)
def id_maker(path: str) -> IdMaker:
    """One for each file in a worker, so that its words serve all tasks."""
    return IdMaker(path)


def _pieces(path: str, capacity: int, separator: int):
    """Per piece of each document: place, length, checksum, and its number within this task among pieces of its length."""
    kind = pa.schema([("rid", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("number", pa.int64())])

    def run(batches):
        ids_of, seen, part = id_maker(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi in by_bytes(batch.column("text"), SLICE_BYTES):
                data, at = utf8(batch.column("text")[lo:hi])
                data, rows = data.tobytes(), []
                for rid, a, b in zip(batch.column("rid")[lo:hi].to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    ids = np.append(ids_of(data[a:b]), np.uint32(separator)).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), capacity)):
                        piece = ids[s : s + capacity]
                        rows.append((rid, k, s, len(piece), zlib.crc32(piece.tobytes()), part, int(seen[len(piece)])))
                        seen[len(piece)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return run


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = 1024, small: float = 1 / 4) -> np.ndarray:
    """Rows (length, first rank, number of ranks, first sequence, offset) for counts[length] documents of each length.

    Rank r of the length lies in sequence first sequence + r - first rank at the offset.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    counts = np.asarray(counts, np.int64)
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, how many)
    made = 0
    if counts[capacity]:
        rows.append((capacity, 0, int(counts[capacity]), 0, 0))
        made = int(counts[capacity])
    limit = max(1, int(capacity * small))
    # Linear grouping: large lengths in falling order, cut into groups of the same number of documents.
    large = [(n, int(counts[n])) for n in range(capacity - 1, limit, -1) if counts[n]]
    total = sum(c for _, c in large)
    each = max(1, -(-total // groups))
    sizes: list[int] = []
    members: list[list[list[int]]] = []  # of each group: [length, first rank, count]
    room = 0
    for n, c in large:
        rank = 0
        while c:
            if not room:
                if not sizes or sizes[-1] != n:
                    sizes.append(n)
                    members.append([])
                room = each
            k = min(c, room)
            members[-1].append([n, rank, k])
            rank, c, room = rank + k, c - k, room - k
    left = [sum(m[2] for m in g) for g in members]
    # Configurations: the largest size that is left, and with it the sizes that fill the sequence best.
    first = 0
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        config = _fill(sizes, left, first, capacity)
        times = min(left[j] // k for j, k in config.items())
        slots = [j for j, k in sorted(config.items()) for _ in range(k)]
        for j, k in config.items():
            left[j] -= times * k
        # Actual documents: each slot takes the next `times` ones of its group; cut where a length changes.
        queues = [_take(members[j], times) for j in slots]
        while times:
            step = min(q[0][2] for q in queues)
            used = 0
            for q in queues:
                n, rank, k = q[0]
                rows.append((n, rank, step, made, used))
                used += n
                if k == step:
                    q.pop(0)
                else:
                    q[0] = [n, rank + step, k - step]
            free[capacity - used].append((made, step))
            made, times = made + step, times - step
    # Small documents, largest first, into the least room that holds them.
    for n in range(limit, 0, -1):
        rank, c, r = 0, int(counts[n]), n
        while c:
            while r <= capacity and not free[r]:
                r += 1
            if r > capacity:
                held = capacity // n
                bins = -(-c // held)
                free[capacity].append((made, bins))
                made, r = made + bins, capacity
                continue
            seq, bins = free[r].pop()
            held = min(r // n, c)
            use = min(bins, c // held)
            if use < bins:
                free[r].append((seq + use, bins - use))
            for s in range(held):
                rows.append((n, rank + s * use, use, seq, capacity - r + s * n))
            rank, c = rank + held * use, c - held * use
            free[r - held * n].append((seq, use))
            r = n if r - held * n >= n else r
    return np.array(rows, np.int64).reshape(-1, 5)


def _fill(sizes: list[int], left: list[int], first: int, capacity: int) -> dict[int, int]:
    """Group -> how many, with ``first`` among them: the best fill of a sequence by groups that have documents left."""
    room = capacity - sizes[first]
    came = np.full(room + 1, -1, np.int64)  # the group that reached this sum last
    came[0] = len(sizes)
    usable = [j for j in range(first, len(sizes)) if sizes[j] <= room and left[j] - (j == first) > 0]
    for j in usable:
        n = sizes[j]
        for _ in range(min(left[j] - (j == first), room // n)):
            reach = np.flatnonzero((came[: room + 1 - n] >= 0) & (came[n:] < 0))
            if not len(reach):
                break
            came[reach + n] = j
    at, config = int(np.flatnonzero(came >= 0)[-1]), {first: 1}
    while at:
        j = int(came[at])
        config[j] = config.get(j, 0) + 1
        at -= sizes[j]
    return {j: min(k, left[j]) for j, k in config.items()}


def _take(group: list[list[int]], times: int) -> list[list[int]]:
    """The next ``times`` documents of a group, removed from it."""
    out = []
    while times:
        n, rank, k = group[0]
        use = min(k, times)
        out.append([n, rank, use])
        times -= use
        if use == k:
            group.pop(0)
        else:
            group[0] = [n, rank + use, k - use]
    return out


def _places(rows: np.ndarray):
    """Looks up (sequence, offset) of (length, rank) columns in the plan."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    key = (rows[:, 0].astype(np.uint64) << np.uint64(48)) | rows[:, 1].astype(np.uint64)

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length.astype(np.uint64) << np.uint64(48)) | rank.astype(np.uint64), side="right") - 1
            found = {"sequence_id": pa.array(rows[at, 3] + rank - rows[at, 1]), "offset": pa.array(rows[at, 4])}
            keep = [c for c in batch.schema.names if c not in ("part", "number", "rank")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(found.values()), names=keep + list(found))

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, groups: int = 1024, small: float = 1 / 4) -> DataFrame:
    """A row per piece of each document with its sequence and its offset there.

    Columns: the id, piece, start, length, ids_crc32, sequence_id, offset. ``tokenizer`` is the path of a tokenizers
    file, the same on all machines. A null or empty text is the separator alone. Rows with a repeated or null id are
    packed as documents of their own. An empty table gives no rows. Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "pack")
    rows, is_id = with_rid(docs, id_col, ws, text_col)
    texts = rows.select(F.col(RID).alias("rid"), F.col(text_col).cast("string").alias("text"))
    pieces = texts.mapInArrow(_pieces(tokenizer, capacity, separator), "rid long, piece int, start long, length long, ids_crc32 long, part int, number long")
    pieces = ws.table(pieces, "pieces")
    counts = ws.table(pieces.groupBy("length", "part").count(), "counts")
    before = counts.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    # At most `capacity` rows, whatever the corpus.
    histogram = np.zeros(capacity + 1, np.int64)
    for n, c in counts.groupBy("length").agg(F.sum("count")).collect():
        histogram[n] = c
    # By a shuffle: both sides grow with the corpus, and the size of the file of `before` says little about its size in memory.
    ranked = pieces.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("number") + F.col("before")).drop("before")
    kept = ranked.select("rid", "piece", "start", "length", "ids_crc32", "part", "number", "rank")
    placed = kept.mapInArrow(_places(plan(histogram, capacity, groups, small)), "rid long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    if is_id:
        return placed.withColumnRenamed("rid", id_col)
    named = placed.join(rows.select(F.col(RID).alias("rid"), F.col(id_col)), "rid")
    return named.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

