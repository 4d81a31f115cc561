import re
from collections import defaultdict
from hashlib import sha256

from tidemark.llm.exact_dedup import exact_groups

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted((i, min(g), len(g), i == min(g), sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def check(df, **kw):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = exact_groups(df, **kw)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_rows_with_small_blocks(odd):
    check(odd, block_bytes=64)


def test_odd_rows(odd):
    check(odd)


def test_sample(sample):
    check(sample)


def test_empty(empty):
    assert exact_groups(empty).collect() == []


def test_repeated_ids(repeated):
    got = sorted(map(tuple, exact_groups(repeated).select("keep_id", "group_size", "kept").collect()), key=str)
    assert sum(k for *_, k in got) == 3 and sorted(n for _, n, _ in got) == [1, 1, 4, 4, 4, 4]
    assert {k for k, n, _ in got if n == 4} == {1}


def test_equal_blocks_over_many_partitions(spark):
    """One block that most rows share, and runs of it that span partitions."""
    rows = [(i, "same" * 8 + ("" if i % 3 else str(i))) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
