"""Every query against DuckDB on the same tables."""

import duckdb
import pytest

from tidemark import feed_queries  # noqa: F401  registers its queries
from tidemark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in at], sorted((tuple(norm(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    said = duck.sql(ORACLE_SQL[name])
    assert plain(rows, found.columns) == plain(said.fetchall(), said.columns)
