"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of characters that are not letters becomes one blank. All n-grams of one to
``MAX_N`` characters are hashed to ``BUCKETS`` features. Training counts features per language; the matrix of log
probabilities (languages x buckets) is broadcast. Scoring is a sparse product in numpy: for each slice of texts, the
rows of the matrix at the text's features are summed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix

#: Features: a power of two. Orders 1 to MAX_N are used. ALPHA is added to each count.
BUCKETS, MAX_N, ALPHA = 1 << 16, 4, 0.5
#: About so many training rows for each language at most, taken by a hash of id and text, so that copies of a text are taken one by one: a bound on the fit alone.
TRAIN_ROWS = 4000
UNKNOWN = "und"
#: Characters worked on at once: what a worker holds is some 150 bytes for each of them.
SLICE_CHARS = 1 << 18
_BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a blank."""
    return np.fromiter((c if chr(c).isalpha() else _BLANK for c in range(0x110000)), np.uint32, 0x110000)


class Features:
    def __init__(self):
        self.letters = _letters()

    def __call__(self, texts: list[str]):
        """(features, index of each feature's text) for slices of the texts. How a long text is sliced doesn't change its features."""
        held, size = [], 0
        for k, text in enumerate(texts):
            if len(text) > SLICE_CHARS:
                yield from self._long(k, text)
                continue
            held.append((k, text))
            size += len(text)
            if size >= SLICE_CHARS:
                yield self._slice(held)
                held, size = [], 0
        if held:
            yield self._slice(held)

    def _long(self, k: int, text: str):
        """One text: its codes as a whole, four bytes a character; n-grams are hashed where they begin, slice by slice."""
        codes, s = [np.array([_BLANK], np.uint32)], 0
        while s < len(text):
            e = min(s + SLICE_CHARS, len(text))
            while e < len(text) and text[e].isalpha():  # lower case can depend on the letters beside
                e += 1
            codes.append(self.letters[np.frombuffer(text[s:e].lower().encode("utf-32-le", "surrogatepass"), np.uint32)])
            s = e
        code = np.concatenate([*codes, codes[0]])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != _BLANK) | (code[:-1] != _BLANK)
        code = code[keep]
        for s in range(0, len(code), SLICE_CHARS):
            part = code[s : s + SLICE_CHARS + MAX_N - 1].astype(np.uint64)
            out, own, h = [], [], np.zeros(len(part), np.uint64)
            with np.errstate(over="ignore"):
                for n in range(1, MAX_N + 1):
                    m = len(part) - n + 1
                    if m <= 0:
                        break
                    h = h[:m] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
                    begun = h[:SLICE_CHARS] if n > 1 else h[:SLICE_CHARS][part[:SLICE_CHARS] != _BLANK]
                    out.append((mix(begun) & np.uint64(BUCKETS - 1)).astype(np.int32))
                    own.append(np.full(len(begun), k))
            yield out, own

    def _slice(self, held):
        # A blank on either side of each part, and an end, told by its place, that no n-gram crosses. A text's own NUL is a blank.
        parts = [f" {part.lower()} \0" for _, part in held]
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.zeros(len(code), bool)
        end[np.cumsum([len(part) for part in parts]) - 1] = True
        code = np.where(end, 0, self.letters[code]).astype(np.uint32)
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != _BLANK) | (code[:-1] != _BLANK)
        code, end = code[keep].astype(np.uint64), end[keep]
        owner = np.cumsum(end) - end
        which = np.array([k for k, _ in held])
        out, own = [], []
        h, ok = np.zeros(len(code), np.uint64), np.ones(len(code), bool)
        with np.errstate(over="ignore"):
            for n in range(1, MAX_N + 1):
                m = len(code) - n + 1
                if m <= 0:
                    break
                h = h[:m] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
                ok = ok[:m] & (code[n - 1 :] != 0)
                use = ok if n > 1 else ok & (code != _BLANK)
                out.append((mix(h[use]) & np.uint64(BUCKETS - 1)).astype(np.int32))
                own.append(which[owner[:m][use]])
        return out, own


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x BUCKETS

    def scores(self, features: Features, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log of prior times likelihood per text and language; whether the text has a letter."""
        total, letter = np.tile(self.log_prior, (len(texts), 1)), np.zeros(len(texts), bool)
        for out, own in features(texts):
            for n, (f, o) in enumerate(zip(out, own)):
                if not len(f):
                    continue
                begin = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                if n == 0:
                    letter[o[begin]] = True
                for k in range(len(self.languages)):
                    np.add.at(total[:, k], o[begin], np.add.reduceat(self.log_prob[k][f], begin, dtype=np.float64))
        return total, letter

    def best(self, features: Features, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The language of each text, UNKNOWN where it has no letter, and its posterior."""
        names = np.array([*self.languages, UNKNOWN], object)
        if not self.languages:
            return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        total, letter = self.scores(features, texts)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return names[np.where(letter, total.argmax(1), -1)], np.where(letter, score, 0.0)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> Model:
    """A model of the rows' languages; rows with null text or language are left out.

    The fit takes about ``train_rows`` rows of a language, chosen by a hash of the id and the text; the priors count all rows.
    The driver gets at most languages x BUCKETS counts.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    found = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for lang, n in found.items() for x in (lang, min(1.0, train_rows / n))])
    sample = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    counted = sample.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(found)
    counts = np.full((len(languages), BUCKETS), ALPHA)
    got = counted.toArrow()
    at = np.searchsorted(np.array(languages), np.array(got["lang"].to_pylist(), dtype=str)) if got.num_rows else np.zeros(0, int)
    np.add.at(counts, (at, got["bucket"].to_numpy()), got["n"].to_numpy())
    prior = np.array([found[x] for x in languages], float)
    return Model(languages, np.log(prior / prior.sum()), np.log(counts / counts.sum(1, keepdims=True)))


def _count(batches):
    features, counts = Features(), {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for out, own in features(batch.column("text").to_pylist()):
            for f, o in zip(out, own):
                for lang in set(langs[o].tolist()) if len(o) else ():
                    counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    counts[lang] += np.bincount(f[langs[o] == lang], minlength=BUCKETS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])


def _predict(model):
    def run(batches):
        features = Features()
        for batch in batches:
            lang, score = model.value.best(features, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return run


def _accept(model, text_col: str, least: float):
    def run(batches):
        features = Features()
        for batch in batches:
            lang, score = model.value.best(features, [t or "" for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array((lang != UNKNOWN) & (score >= least), pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose text has a language with at least this score. No shuffle."""
    return docs.mapInArrow(_accept(docs.sparkSession.sparkContext.broadcast(model), text_col, least), docs.schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row; `und` with score 0 where the text is null or has no letter, or no language was learned.

    The score is the posterior of the predicted language. Of equal scores the first language by name is taken. Null
    and repeated ids are passed on. Other columns are not read. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(_predict(shared), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id") -> Column:
    """Remainder by four of the CRC-32 of the id's text; remainder 2 is held out from training."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.coalesce(fold(id_col) != 2, F.lit(True)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts all rows: (id, held_out, lang_pred, score)."""
    model = fit(training_rows(docs, id_col), text_col, lang_col, id_col=id_col)
    return predict(docs, model, id_col, text_col).select(id_col, F.coalesce(fold(id_col) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
