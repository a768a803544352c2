from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqweave import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = core.QUERIES[name](spark, SF)
    want = duck.execute(core.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())


def test_entry(spark):
    assert sorted((r["query_id"], r["target_id"], r["span"]) for r in entry.entry(spark).collect()) == [(52, 39, 232), (64, 16, 214), (188, 33, 154)]
    assert set(entry.oracle_sql()) <= set(entry.queries())
