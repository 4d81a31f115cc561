import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.packing import pack, plan
from tidemark.llm.queries import TOKENIZER, vocabulary


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(TOKENIZER))
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(df, capacity=2048):
    rows = df.select("doc_id", "text").collect()
    got = pack(df, vocabulary(TOKENIZER), capacity=capacity).collect()
    expected = []
    for (i, _), ids in zip(rows, ids_of([r.text for r in rows])):
        for k, s in enumerate(range(0, len(ids), capacity)):
            piece = ids[s : s + capacity]
            expected.append((i, k, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), sum(len(x) for x in ids_of([r.text for r in rows]))


def test_odd(odd):
    check(odd)


def test_small_capacity(sample):
    n, tokens = check(sample, 512)
    assert n <= 1.02 * tokens / 512 + 2


def test_empty(empty):
    assert pack(empty, vocabulary(TOKENIZER)).collect() == []


def test_repeated_ids(repeated):
    got = pack(repeated, vocabulary(TOKENIZER)).collect()
    assert len(got) == 6 and {r.sequence_id for r in got} == {got[0].sequence_id}


@pytest.mark.parametrize("n", [1, 3, 50, 2000])
def test_plan_is_close_to_the_least(n):
    rng = np.random.default_rng(n)
    counts = np.bincount(np.clip(rng.lognormal(6.3, 1.1, n).astype(int), 1, 2048), minlength=2049)
    rows = plan(counts)
    least = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert (rows[:, 3] + rows[:, 2]).max() <= max(least + 2, 1.01 * least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80), st.integers(1, 12))
def test_plan_places_every_document_once(lengths, groups):
    counts = np.bincount(lengths, minlength=65)
    rows = plan(counts, 64, groups)
    seen, bins = defaultdict(set), defaultdict(list)
    for n, rank, k, seq, offset in rows.tolist():
        for i in range(k):
            assert rank + i not in seen[n]
            seen[n].add(rank + i)
            bins[seq + i].append((offset, n))
    assert {n: len(s) for n, s in seen.items()} == {n: c for n, c in enumerate(counts.tolist()) if c}
    assert all(max(s) < counts[n] for n, s in seen.items())
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
