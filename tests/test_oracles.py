"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = {k: v for k, v in __spark_entry__.oracle_sql().items() if k.startswith("q_")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, TABLES)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(found.fetchall(), columns)


def test_all_queries_are_named_and_entry_runs(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(TABLES):
        assert __spark_entry__.entry(spark).count() > 0
