"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from weft.queries import ORACLE_SQL, QUERIES
from weft import queries_more  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(ORACLE_SQL[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    want = [tuple(r[have.index(c)] for c in cols) for r in rel.fetchall()]
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs_alike_twice(spark, name):
    a, b = (plain(tuple(r) for r in QUERIES[name](spark, SF).collect()) for _ in range(2))
    assert a == b
