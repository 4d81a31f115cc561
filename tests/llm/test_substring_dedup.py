import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tidemark.llm import substring_dedup as S
from tidemark.llm.substring_dedup import anchors, remove_repeats


def brute(rows, length=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(d[k : k + length]) for _, d in data for k in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, int)
        for k in range(len(d) - length + 1):
            if seen[hash(d[k : k + length])] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(d) else 0
        out.append((i, len(d), int(gone.sum()), runs, sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def check(df, **kw):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    found = remove_repeats(df, **kw).collect()
    assert all(r.changed == (r.n_removed > 0) for r in found)
    got = sorted((tuple(r)[:5] for r in found), key=str)
    assert got == brute(rows)
    return got


def made(seed):
    """Passages of lengths around the limit, in different surroundings, chained, periodic, and within one text."""
    rng = random.Random(seed)
    words = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passages = [words(n) for n in (350, 398, 401, 450, 700, 1500)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 3)
            parts += [words(rng.randrange(0, 300)), p[a:] if rng.random() < 0.5 else p]
        text = "".join(parts)
        if rng.random() < 0.3:
            k = rng.randrange(len(text))
            text = text[:k] + "#" + text[k + 1 :]
        texts.append(text)
    return texts + [texts[0], texts[1], "ab" * 700, "xyz " * 300 + "ab" * 300, words(900) * 2]


@pytest.mark.parametrize("seed,bucket,size", [(1, 8 << 20, 1 << 20), (2, 3000, 1 << 20), (3, 8 << 20, 2000)])
def test_made(spark, seed, bucket, size, monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", size)
    got = check(spark.createDataFrame(list(enumerate(made(seed))), "doc_id long, text string").repartition(4), bucket_bytes=bucket)
    assert sum(r[2] > 0 for r in got) > 40


def test_sample(sample):
    check(sample)


def test_odd(odd):
    check(odd)


def test_empty(empty):
    assert remove_repeats(empty).collect() == []


def test_repeated(spark):
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    check(spark.createDataFrame([(1, long), (1, long), (None, "z" + long), (2, "c")], "doc_id long, text string"))


def test_every_window_has_one_stretch():
    texts = [t.encode() for t in made(5)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    text, place, lo, hi, *_ = anchors(data, at)
    for k, t in enumerate(texts):
        mine = text == k
        covered = sorted((a, b) for a, b in zip(lo[mine].tolist(), hi[mine].tolist()))
        flat = [i for a, b in covered for i in range(a, b + 1)]
        assert flat == list(range(max(0, len(t) - 399)))
        assert all(b <= p <= a + 272 for p, a, b in zip(place[mine], lo[mine], hi[mine]))
