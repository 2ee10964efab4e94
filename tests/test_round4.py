"""Findings of round 4, on tables made here."""

import os

import pytest
from pyspark.sql import functions as F

from veilspark.operators import registry as R
from veilspark.plans import QUERIES


def test_pairs_of_many_policies_pack(spark, tmp_path):
    """the bytes of a pair do not grow with the policies of its key."""
    spark.range(1, 301).selectExpr("id * 350 + 57 AS o_orderkey", "id AS o_custkey", "'1995-01-01' AS o_orderdate", "1.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 5001).selectExpr("id * 28 + 8 AS p_partkey", "8 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    QUERIES["policy_version_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.where("status = 'approved'").distinct().count() == 300 * 5000
    assert sum(os.path.getsize(f"{tmp_path}/out/{f}") for f in os.listdir(f"{tmp_path}/out") if f.endswith(".parquet")) < 0.4 * 300 * 5000


@pytest.mark.parametrize("rows, cols, block, pairs", [(1 << 14, 1 << 11, 168, 1 << 25), (4, 3, 2, 100), (2, 1, 1, 100)])
def test_pairs_equal_a_left_join(spark, monkeypatch, rows, cols, block, pairs):
    """a hot key, keys and rows without a partner, keys that are null, repeated rows; in one cell and in many."""
    for name, value in {"CELL_LEFT": rows, "CELL_RIGHT": cols, "BLOCK": block, "TASK_PAIRS": pairs, "TASK_ROWS": pairs}.items():
        monkeypatch.setattr(R, name, value)
    left = [(i, "hot", 1) for i in range(40)] + [(7, "hot", 1), (50, "cold", 1), (51, "cold", 2), (52, "none", 1), (53, None, 1), (54, "hot", None), (None, "hot", 1), (None, None, None)]
    right = [(i, "hot", 1, "approved") for i in range(25)] + [(3, "hot", 1, "approved"), (30, "cold", 1, None), (31, "other", 1, "approved"), (32, None, 1, "approved"), (None, "cold", 2, "approved")]
    a = spark.createDataFrame(left, "v long, name string, version long")
    b = spark.createDataFrame(right, "p long, name string, version long, status string")
    got, wanted = R.pairs(a, b, ["name", "version"], "v", "p").select("v", "p", "status"), a.join(b, ["name", "version"], "left").select("v", "p", "status")
    order = lambda df: sorted(map(str, df.collect()))
    assert order(got) == order(wanted) and len(order(got)) == 42 * 26 + 6


def test_pairs_of_empty_tables(spark):
    a = spark.createDataFrame([], "v long, k string")
    b = spark.createDataFrame([(1, "x")], "p long, k string")
    assert R.pairs(a, b, ["k"], "v", "p").count() == 0
    assert [r.asDict() for r in R.pairs(b, a, ["k"], "p", "v").collect()] == [{"k": "x", "p": 1, "v": None}]


def test_a_hot_key_is_many_tasks(spark, monkeypatch):
    """the pairs of one key leave in more than one partition."""
    monkeypatch.setattr(R, "CELL_LEFT", 16)
    a, b = spark.createDataFrame([(i, "hot") for i in range(1000)], "v long, k string"), spark.createDataFrame([(i, "hot") for i in range(300)], "p long, k string")
    got = R.pairs(a, b, ["k"], "v", "p")
    assert got.select(F.spark_partition_id().alias("i")).distinct().count() > 1 and got.count() == 300000
