"""Every query of the engine over the small tables, against its SQL on another engine."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chainlens.operators import adjacency, splits
from chainlens.plans import queries
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
#: These have tests of their own.
ELSEWHERE = {"lenient_tamper_matrix", "strict_tamper_matrix", "strict_caps"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLES.keys() - ELSEWHERE))
def test_as_sql_does(spark, sql, name):
    got = queries.QUERIES[name](spark, DATA)
    want = sql.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.ORACLES.keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert queries.QUERIES.items() <= entry.queries().items() and queries.ORACLES.items() <= entry.oracle_sql().items()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("size", [1, 7, 1000])
@pytest.mark.parametrize("outlier", [0, 10**15])
def test_buckets_of_neighbours(spark, size, outlier, monkeypatch):
    monkeypatch.setattr(adjacency, "CUTS", 9)
    values = [(k * k % 101, k) for k in range(60)] + [(50, 100 + k) for k in range(20)] + [(outlier, 500)]
    t = spark.createDataFrame(values, "a long, k long")
    got = adjacency.with_previous(t, [F.col("a"), F.col("k")], ["k"], rows=size).collect()
    order = sorted(values)
    want = {k: p for (_, k), p in zip(order, [None, *(k for _, k in order)], strict=False)}
    assert {r["k"]: r["prev_k"] for r in got} == want
    assert sum(not r["has_prev"] for r in got) == 1


def test_tables_of_blocks_are_broadcast_only_if_few(spark):
    t = spark.range(3)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(splits.small(t, 3)) and not hinted(splits.small(t, splits.BROADCAST_ROWS + 1))


def test_plans_read_and_move_no_more_than_they_need(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = plan(queries.keystore_join(spark, DATA))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    p = plan(queries.csv_export_rows(spark, DATA))
    assert "Exchange" not in p and "Python" not in p
