"""Every query of the library against DuckDB on the smallest tables."""

import decimal
import glob
import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from veilspark.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    if isinstance(v, (numbers.Number, decimal.Decimal)):
        return format(float(v), ".9g") if math.isfinite(float(v)) else str(v)
    return str(v).removesuffix(" 00:00:00")


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(zip(*([str(value(v)) for v in pdf[c]] for c in columns), strict=True))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(ORACLES[name]).df())
    spark.catalog.clearCache()
