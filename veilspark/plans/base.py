"""Registration of queries with their SQL, and the estate over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 20240101
KEY = b"public-test-key"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Entity -> (table, columns, filter): expressions that Spark and DuckDB read alike.
ESTATE: dict[str, tuple[str, list[str], str | None]] = {
    "member": ("customer", ["c_custkey AS member_id", "c_name AS name", "c_mktsegment AS gender", "c_acctbal AS balance"], None),
    "member_demographics": ("customer", ["c_custkey AS member_id", "CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE c_mktsegment END AS segment", "c_nationkey AS nation"], "c_custkey % 11 <> 3"),
    "address": ("customer", ["c_custkey + 100000000 AS address_id", "CASE WHEN c_custkey % 40 = 1 THEN c_custkey + 900000000 ELSE c_custkey END AS member_id", "CASE c_custkey % 50 WHEN 0 THEN '00000' WHEN 1 THEN 'ABCDE' WHEN 2 THEN '' ELSE CAST(10000 + c_custkey % 80000 AS VARCHAR(10)) END AS zip"], None),
    "coverage": ("customer", ["c_custkey + 200000000 AS coverage_id", "c_custkey AS member_id", "c_nationkey AS plan_id", "CASE WHEN c_acctbal < 0 THEN 'terminated' ELSE 'active' END AS status"], "c_custkey % 20 <> 7"),
    "plan": ("nation", ["n_nationkey AS plan_id", "n_name AS plan_name", "n_regionkey AS region_id"], "n_nationkey <> 11"),
    "provider": ("supplier", ["s_suppkey AS provider_id", "s_name AS provider_name", "s_nationkey AS nation"], None),
    "pharmacy": ("supplier", ["s_suppkey AS pharmacy_id", "s_name AS pharmacy_name"], "s_suppkey % 3 <> 2"),
    "code": ("part", ["p_partkey AS code", "p_name AS description", "p_type AS kind"], "p_partkey % 37 <> 5"),
    "claim": ("orders", ["o_orderkey AS claim_id", "o_custkey AS member_id", "o_orderkey % 113 AS provider_id", "CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'denied' END AS status", "CAST(o_orderdate AS DATE) AS service_date", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS service_text", "CASE WHEN o_orderkey % 61 = 9 THEN -o_totalprice ELSE o_totalprice END AS billed", "CASE WHEN year(o_orderdate) <= 1998 THEN '2024Q4' ELSE '2025Q1' END AS batch"], None),
    "claim_line": ("lineitem", ["l_orderkey AS claim_id", "l_linenumber AS line_number", "l_partkey AS code", "l_suppkey AS provider_id", "l_extendedprice AS charge"], None),
    "prescription": ("events", ["event_id AS rx_id", "user_id AS member_id", "event_id % 101 AS pharmacy_id", "event_id % 107 AS prescriber_id", "CASE WHEN event_id % 45 = 2 THEN -value ELSE value END AS quantity"], "event_type = 'purchase'"),
    "encounter": ("events", ["event_id AS encounter_id", "user_id AS member_id", "event_id % 109 AS provider_id", "CASE event_id % 30 WHEN 1 THEN 'TBD' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN '' ELSE CAST(CAST(ts AS DATE) AS VARCHAR(10)) END AS discharge_date"], "event_type = 'click'"),
    "lab_ehr": ("events", ["event_id AS lab_id", "user_id AS member_id", "value AS result", "CAST(ts AS DATE) AS collected"], "event_type = 'view'"),
    "lab_partner_v1": ("events", ["event_id AS lab_id", "CASE WHEN event_id % 5 = 0 THEN user_id + 700000000 ELSE user_id END AS pat_id", "value AS result"], "event_type = 'error'"),
    "lab_partner_v2": ("events", ["event_id AS lab_id", "CASE WHEN event_id % 5 = 0 THEN user_id + 700000000 ELSE user_id END AS member_id", "value AS result"], "event_type = 'signup'"),
}


def names(e: str) -> list[str]:
    """The columns of an entity."""
    return [re.split(r"\s+AS\s+", c)[-1] for c in ESTATE[e][1]]


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, where = ESTATE[name]
    df = table(spark, sf_dir, source)
    return (df.where(where) if where else df).selectExpr(*columns)


def estate(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All entities, lazily."""
    return {name: entity(spark, sf_dir, name) for name in ESTATE}


WITH = "WITH " + ",\n".join(f"{name} AS (SELECT {', '.join(columns)} FROM {source}{f' WHERE {where}' if where else ''})" for name, (source, columns, where) in ESTATE.items())
