"""Token counts of texts for a sentencepiece BPE model, by the whole-token shortcut.

The model turns blanks into the sign U+2581 and puts one before the text. No piece of the vocabulary has that sign after
another character (checked when the model is read), so no merge crosses from a word to the blank after it: each word
with the one blank before it can be encoded by itself. Which words are a single token is proved before the job, by
encoding every vocabulary string of that shape alone; those count one without any merging. The others are encoded
once in a worker and remembered. Runs of blanks are taken together with the word after them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, utf8
from tidemark.llm.words import WordNumbers, pieces_of

LIMIT = 4096
BLANK = "▁"
SLICE_BYTES, REMEMBERED = 4 << 20, 600_000
_RUN = re.compile(rb" +[^ ]*")


def whole_tokens(model: str) -> list[bytes]:
    """The words that the model proves to encode, alone and with a blank before, as exactly one token.

    Raises ValueError for a model whose pieces cross blanks or that changes texts before it encodes them, for then
    words can't be counted one by one.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    found = [(n, m.id_to_piece(n)) for n in range(m.get_piece_size()) if not (m.is_control(n) or m.is_unknown(n) or m.is_byte(n) or m.is_unused(n))]
    if any(BLANK in p.lstrip(BLANK) for _, p in found) or m.encode("  Aﬁ  ", out_type=str)[0].strip(BLANK) or m.encode("x  ") == m.encode("x"):
        raise ValueError(f"{model}: its pieces cross blanks, or it normalises texts")
    words = [(n, p[1:]) for n, p in found if p[:1] == BLANK and len(p) > 1 and p[1] != BLANK]
    return [w.encode() for (n, w), ids in zip(words, m.encode([w for _, w in words])) if ids == [n]]


class Counter:
    def __init__(self, model: str, single: list[bytes]):
        import sentencepiece

        self.model, self.single = sentencepiece.SentencePieceProcessor(model_file=model), single
        self._clear()

    def _clear(self) -> None:
        self.words, self.n = WordNumbers(), np.zeros(1 << 16, np.int32)
        self.words.of(self.single)
        self.words.fresh = []
        self.n[: len(self.single)] = 1

    def __call__(self, text: bytes) -> int:
        if not text:
            return 0
        total, text = 0, text.replace(BLANK.encode(), b" ")
        for part in pieces_of(b" " + text, SLICE_BYTES, b" "):
            if len(self.words) > REMEMBERED:
                self._clear()
            # A word stands for itself with one blank before; a longer run of blanks is part of the word's string.
            if b"  " in part or part[-1:] == b" ":
                words = [x[1:] for x in _RUN.findall(part)]
            else:
                words = part[1:].split(b" ")
            numbers = self.words.of(words)
            if fresh := self.words.fresh:
                self.words.fresh = []
                counts = [len(x) if w else 1 for w, x in zip(fresh, self.model.encode([w.decode() for w in fresh], num_threads=1))]
                while len(self.words) > len(self.n):
                    self.n = np.concatenate([self.n, np.zeros_like(self.n)])
                self.n[len(self.words) - len(fresh) : len(self.words)] = counts
            total += int(self.n[numbers].sum())
        return total


_counters: dict[str, Counter] = {}


def _counter(model: str, single: list[bytes]) -> Counter:
    """One for each model in a worker, so that its words serve all tasks."""
    if model not in _counters:
        _counters[model] = Counter(model, single)
    return _counters[model]


def _counts(model: str, single):
    def run(batches):
        count = _counter(model, single.value)
        for batch in batches:
            for lo, hi in by_bytes(batch.column("text"), SLICE_BYTES):
                data, at = utf8(batch.column("text")[lo:hi])
                data, ends = data.tobytes(), at.tolist()
                n = [count(data[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id")[lo:hi], pa.array(np.diff(at)), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row, as the library gives them without special tokens.

    ``model`` is the path of a sentencepiece model, the same on all machines. A null text counts as empty, with no
    tokens. Null and repeated ids are passed on, a row for each input row. Other columns are not read. No shuffle.
    """
    single = docs.sparkSession.sparkContext.broadcast(whole_tokens(model))  # at most the vocabulary
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(_counts(model, single), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
