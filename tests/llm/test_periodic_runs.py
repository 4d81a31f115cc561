"""Runs against a search over all periods and starts."""

import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import queries
from tidemark.llm.periodic_runs import find_runs, periodic_runs


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(r, n, letters):
    """Words with nested and touching repeats."""
    out = []
    while len(out) < n:
        unit = [r.randrange(letters) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13]))]
        times = r.choice([1, 1, 2, 4, 5, 9])
        out += unit * times + unit[: r.randrange(len(unit) + 1)]
        if r.random() < 0.2 and len(out) < n:
            out += (out[-20:]) * 4
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs(seed):
    r = random.Random(seed)
    docs = [made(r, r.choice([0, 1, 5, 6, 7, 30, 120, 400]), r.choice([1, 2, 3, 30])) for _ in range(12)] + [[1] * r.randrange(40)]
    rows = find_runs(np.array([w for d in docs for w in d], np.int64), np.array([len(d) for d in docs]))
    got = [[tuple(map(int, x[1:])) for x in rows if x[0] == k] for k in range(len(docs))]
    assert got == [brute(d) for d in docs]


def test_odd(odd):
    rows = {r.doc_id: r.text for r in odd.collect()}
    for size in (1 << 20, 64):
        got = {r.doc_id: r for r in periodic_runs(odd, slice_bytes=size).collect()}
        assert set(got) == set(rows)
        for k, text in rows.items():
            words = split(text)
            runs = [(0, 60_000, 1)] if k in (6, 8) else brute(words)
            assert [tuple(x) for x in got[k].runs] == runs
            assert got[k].collapsed == ("word" if k in (6, 8) else collapsed(words, runs))


def test_repeated_and_empty(repeated, empty):
    assert sorted(r.collapsed for r in periodic_runs(repeated).collect()) == ["", "a b", "a b", "a b", "a b", "c"]
    assert periodic_runs(empty).collect() == []


def planted(doc_id, text):
    words = split(text)
    h, n = crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = brute([numbers[w] for w in words])
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    digest = lambda s: sha256(s.encode()).hexdigest()
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *most, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(words, runs)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark, sample):
    found = queries.op11_periodic_runs(spark, "/root/testdata/sf0.001")
    assert found.columns == COLUMNS
    got = sorted(map(tuple, found.collect()))
    want = sorted(expected(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect())
    assert got == want and sum(w[1] > 0 for w in want) > 5


def test_planted_text(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 37))) for k in range(400)] + [(1000, None), (1001, ""), (None, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in queries.with_planted_runs(df).collect():
        text = dict(rows)[r.doc_id]
        assert split(r.text) == (planted(r.doc_id, text) if r.doc_id is not None else split(text))
