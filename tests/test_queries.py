"""Every registered query of the core against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from quadframe.plans import graph, relational  # noqa: F401
from quadframe.plans.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not there")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, int) and not isinstance(v, bool):
        return str(v)
    return f"{float(v):.6g}" if not isinstance(v, (bool, str)) and hasattr(v, "__float__") else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE[name]})").fetchall()
    found = df.select(columns).collect()
    assert sorted(tuple(map(cell, r)) for r in found) == sorted(tuple(map(cell, r)) for r in want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
