import datetime

from tidemark.llm.url_filter import judge, validity
from tidemark.operators import ordered

D = datetime.date


def lists(spark, rows):
    return spark.createDataFrame(rows, "pattern string, action string, day date")


ENTRIES = [
    ("Bad.com", "add", D(2024, 1, 10)), ("bad.com", "remove", D(2024, 3, 1)), ("bad.com", "add", D(2024, 6, 1)), ("bad.com", "add", D(2024, 7, 1)),
    ("site.org/ads/", "add", D(2024, 2, 1)), ("x.bad.com", "add", D(2024, 2, 20)), ("tie.net", "add", D(2024, 1, 1)), ("tie.net", "remove", D(2024, 1, 1)),
    (None, "add", D(2024, 1, 1)), ("n.com", None, D(2024, 1, 1)), ("n.com", "add", None), ("n.com", "block", D(2024, 1, 1)), ("", "add", D(2024, 1, 1)), ("never.on", "remove", D(2024, 1, 1)),
]
CAPTURES = [
    (1, "http://bad.com/", D(2024, 1, 9)), (2, "http://BAD.com:80/x", D(2024, 1, 10)), (3, "https://a.b.bad.com", D(2024, 2, 29)), (4, "https://bad.com", D(2024, 3, 1)),
    (5, "https://u:p@bad.com./q?x=bad", D(2030, 1, 1)), (6, "https://notbad.com/", D(2024, 2, 1)), (7, "http://site.org/ads", D(2024, 2, 1)), (8, "http://site.org/ads/1/2?z", D(2024, 2, 2)),
    (9, "http://site.org/adsx", D(2024, 2, 2)), (10, "http://www.site.org/ads", D(2024, 2, 2)), (11, "http://x.bad.com/", D(2024, 2, 25)), (12, "http://tie.net", D(2024, 5, 5)),
    (13, None, D(2024, 2, 2)), (14, "bad.com", D(2024, 2, 2)), (15, "http://bad.com", None), (16, "", D(2024, 2, 2)), (17, "http://n.com/" + "a/" * 2000, D(2024, 2, 2)), (18, "http:///path", D(2024, 2, 2)),
    (None, "http://bad.com", D(2024, 2, 2)), (1, "http://bad.com", D(2024, 2, 2)),
]


def captures(spark, rows):
    return spark.createDataFrame([(i, u, d, "x", "y") for i, u, d in rows], "page_id long, url string, fetched_on date, pattern string, cell string")


def test_cases(spark):
    got = [(r.page_id, r.blocked, r.pattern, r.since, r.n_patterns) for r in judge(captures(spark, CAPTURES), lists(spark, ENTRIES)).collect()]
    hit = sorted(((i, p, str(s), n) for i, b, p, s, n in got if b), key=str)
    assert hit == sorted([
        (2, "bad.com", "2024-01-10", 1), (3, "bad.com", "2024-01-10", 1), (5, "bad.com", "2024-06-01", 1), (7, "site.org/ads", "2024-02-01", 1), (8, "site.org/ads", "2024-02-01", 1),
        (11, "x.bad.com", "2024-02-20", 2), (None, "bad.com", "2024-01-10", 1), (1, "bad.com", "2024-01-10", 1),
    ], key=str)
    assert len(got) == len(CAPTURES)


def test_validity(spark):
    got = sorted((r.pattern, str(r.since), str(r.until)) for r in validity(lists(spark, ENTRIES)).collect())
    assert got == [("bad.com", "2024-01-10", "2024-03-01"), ("bad.com", "2024-06-01", "None"), ("site.org/ads", "2024-02-01", "None"), ("x.bad.com", "2024-02-20", "None")]


def test_empty(spark):
    assert judge(captures(spark, []), lists(spark, ENTRIES)).collect() == []
    assert [r.blocked for r in judge(captures(spark, CAPTURES[:2]), lists(spark, [])).collect()] == [False, False]


def test_long_path(spark):
    """A URL of 20,000 segments, and a pattern of 3,000 of them."""
    path = "/".join(f"s{i}" for i in range(20_000))
    deep = "long.com/" + "/".join(f"s{i}" for i in range(3000))
    rows = [(1, f"http://long.com/{path}", D(2024, 2, 2)), (2, f"http://long.com//{path.replace('s2999/', 'x/')}", D(2024, 2, 2))]
    got = {r.page_id: (r.pattern, r.n_patterns) for r in judge(captures(spark, rows), lists(spark, [(deep, "add", D(2024, 1, 1)), ("long.com/s0/s1", "add", D(2024, 1, 1))])).collect()}
    assert got == {1: (deep, 2), 2: ("long.com/s0/s1", 1)}


def test_long_intervals_of_many_entries(spark):
    """Entries that have been valid for 15 years: one row each in what is joined. One host has most captures."""
    n = 20_000
    entries = spark.range(n).selectExpr("concat('h', id, '.com') AS pattern", "'add' AS action", "date_add(date'2010-01-01', CAST(id % 30 AS int)) AS day")
    seen = spark.range(3 * n).selectExpr("id AS page_id", "concat('http://h', CASE WHEN id % 3 = 0 THEN id % 40000 ELSE 7 END, '.com/x') AS url", "date_add(date'2010-01-15', CAST(id % 5500 AS int)) AS fetched_on")
    got = judge(seen, entries).groupBy("blocked").count().collect()
    want = {}
    for i in range(3 * n):
        h = i % 40000 if i % 3 == 0 else 7
        hit = h < n and i % 5500 + 14 >= h % 30
        want[hit] = want.get(hit, 0) + 1
    assert {r.blocked: r["count"] for r in got} == want


def test_one_pattern_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HEAVY_ROWS", 50)
    monkeypatch.setattr(ordered, "HEAVY_TIMES", 0.5)
    test_cases(spark)
    days = [(D(2024, 1, 1) + datetime.timedelta(3 * i), i) for i in range(100)]
    entries = [("hot.com", "add" if i % 2 == 0 else "remove", d) for d, i in days]
    rows = [(i, "http://hot.com", D(2024, 1, 1) + datetime.timedelta(i)) for i in range(300)]
    got = {r.page_id: r.blocked for r in judge(captures(spark, rows), lists(spark, entries)).collect()}
    assert got == {i: i // 3 % 2 == 0 for i in range(300)}
