import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard_join
from tidemark.llm.components import components
from tidemark.llm.common import Workspace
from tidemark.llm.jaccard_join import similar_groups


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent=85, words=4):
    sets = [shingles(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for pair in {(a, b) for v in at.values() if len(v) > 1 for a in v for b in v if a < b}:
        a, b = (sets[i] for i in pair)
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = map(find, pair)
            up[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, similar_groups(df).collect())) == brute(rows)


def test_sample(sample):
    check(sample)


def test_odd(odd):
    check(odd)


def test_empty(empty):
    assert similar_groups(empty).collect() == []


def test_repeated(repeated):
    got = similar_groups(repeated).collect()
    assert len(got) == 6 and sorted(r.component_id or -1 for r in got) == [-1, 1, 1, 1, 1, 1]


@pytest.mark.parametrize("bits,seed", [(24, 1), (24, 2), (6, 3)])
def test_near_copies(spark, bits, seed):
    """A large group of near copies, smaller ones, shared passages, chains of links and sizes close to the threshold."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]

    def edit(text, n):
        text = list(text)
        for _ in range(n):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        return text

    base, passage, texts = words(120), words(60), []
    texts += [edit(base, rng.randrange(5)) for _ in range(80)]
    texts += [words(30) + passage + words(30) for _ in range(40)]
    for _ in range(20):
        start = words(rng.randrange(3, 90))
        for _ in range(5):
            texts.append(start)
            start = edit(start, rng.randrange(3)) + words(rng.randrange(3))
    rng.shuffle(texts)
    check(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5))


@pytest.mark.parametrize("seed", range(8))
def test_lists_do_not_depend_on_batches(seed):
    rng = np.random.default_rng(seed)
    n = 300
    rows = sorted({(int(a), int(p), 9, int(o), int(r)) for a, p, o, r in zip(rng.integers(0, 60, n), rng.integers(0, 3, n), rng.integers(0, 5, n), rng.integers(0, 99, n))})
    names = ["list", "pos", "n", "own", "rid"]
    cut = sorted({0, len(rows), *rng.integers(0, len(rows), 40).tolist()})
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a:b])], names=names) for a, b in zip(cut, cut[1:])]
    got = [tuple(r.values()) for b in jaccard_join._lists(iter(batches)) for r in b.to_pylist()]
    expected = []
    for x in sorted({r[0] for r in rows}):
        kept, before = [], None
        for r in (r for r in rows if r[0] == x):
            if before is None or r[2:4] != before[2:4]:
                kept.append(r)
            before = r
        if len(kept) > 1:
            expected += [(x, r[4], r[2], r[1], kept[0][4], kept[0][2], kept[0][1]) for r in kept]
    assert got == expected


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"))
    expected = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert dict(map(tuple, got.collect())) == expected and got.count() == len(expected)


def test_hubs_are_not_paired_again(spark, monkeypatch):
    """Of a list, the members but for its hub go on to be paired: of lists of two unlike members none do, of one of three two do."""
    from tidemark.llm import components as module

    lists = [(k, [2 * k, 2 * k + 1]) for k in range(1, 20)] + [(0, [100, 101, 102])]
    rows = [(k, rid, 10, held[0], 10) for k, held in lists for rid in held]
    entries = spark.createDataFrame(rows, "list long, rid long, n long, hub long, hub_n long")
    links, seen, asked, pairs = {(2, 3), (101, 102)}, [], [], module.open_pairs

    def spy(members, *args):
        seen.extend((r.list, r.rid) for r in members.collect())
        return pairs(members, *args)

    def measure(wanted, tag):
        found = [tuple(r) for r in wanted.select("a", "b").collect()]
        asked.extend(found)
        return spark.createDataFrame([(a, b, 9, None, (a, b) in links) for a, b in found], "a long, b long, low long, high long, link boolean")

    monkeypatch.setattr(module, "open_pairs", spy)
    yes = lambda x, y: module.F.lit(True)
    out = module.link_lists(entries, 0.5, lambda x, y: module.F.lit(99), yes, yes, measure, Workspace(spark, "test"))
    assert sorted(map(tuple, out.collect())) == [(2, 2), (3, 2), (101, 101), (102, 101)]
    assert len(asked) == len(set(asked)) == 19 + 3
    assert sorted(seen) == [(0, 101), (0, 102)]


def test_blocks_of_a_long_list_meet_in_proportion_to_it(spark, monkeypatch):
    """Near copies of the hub and members that reach no size of the list are skipped as blocks; one early member meets all copies."""
    from tidemark.llm import components as module

    met, pairs = [], module.block_pairs

    def spy(blocks, can):
        met.append(pairs(blocks, can).count())
        return pairs(blocks, can)

    monkeypatch.setattr(module, "block_pairs", spy)
    may = lambda x, y: (x("n") <= y("reach")) & (y("n") <= x("reach"))
    can = lambda x, y: (x("lo_n") <= y("hi_reach")) & (y("lo_n") <= x("hi_reach"))
    for k in (128, 256):
        near, late, early = range(1, k + 1), range(1000, 1000 + 3 * k), 5000
        rows = [(7, rid, 100, reach, 0, 100, 120) for some, reach in ((near, 110), (late, 90), ((0, early), 120)) for rid in some]
        entries = spark.createDataFrame(rows, "list long, rid long, n long, reach long, hub long, hub_n long, hub_reach long")
        asked = []

        def measure(wanted, tag):
            found = [tuple(r) for r in wanted.select("a", "b").collect()]
            asked.extend(found)
            return spark.createDataFrame([(a, b, 1, None, b != early or a == 1) for a, b in found], "a long, b long, low long, high long, link boolean")

        out = module.link_lists(entries, 0.5, lambda x, y: module.F.lit(99), may, can, measure, Workspace(spark, "test"))
        assert sorted(map(tuple, out.collect())) == [(rid, 0) for rid in (0, *near, early)]
        assert sorted(asked) == sorted([(0, rid) for rid in (*near, early)] + [(rid, early) for rid in near])
    assert met == [2, 4]
