"""Registered queries against their SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from prismlake.plans.queries import QUERIES
from prismlake.plans.sql import SQL

DATA = os.environ.get("PRISMLAKE_TESTDATA", "/root/testdata/sf0.001")
TABLES = ("supplier", "embeddings", "events", "part")


def _plain(v):
    if isinstance(v, float):
        return "inf" if math.isinf(v) else v + 0.0
    return v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    found = sql.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    columns = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    at = [found.columns.index(c) for c in columns]
    assert ours == Counter(tuple(_plain(r[i]) for i in at) for r in found.fetchall())


def test_device_names_of_long_numbers(spark, tmp_path):
    keys = [0, 7, 42, 999, 1000, 1001, 10000, 59999, 2**63 - 1, -5, -1000, 7, None]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    ours = Counter(tuple(r) for r in QUERIES["device_names"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert ours == Counter(con.sql(SQL["device_names"]).fetchall())
    names = dict(ours.keys())
    assert (names[7], names[999], names[1000], names[59999], names[None]) == ("DEVICE-007", "DEVICE-999", "DEVICE-1000", "DEVICE-59999", None)
    assert len(set(names.values())) == len(set(keys))
