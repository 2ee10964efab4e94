"""Findings of round 3, on the smallest tables."""

import os

import pytest

from veilspark.plans import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")


def test_policies_of_a_key_come_together(spark):
    plan = QUERIES["policy_version_join"](spark, SF)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_every_column_with_what_a_steward_decided(spark):
    got = QUERIES["manual_overrides"](spark, SF).collect()
    assert len(got) > 50 and sorted((r.entity, r.column_name) for r in got if r.category) == [("lab_ehr", "result"), ("provider", "provider_name")]


@pytest.mark.parametrize("name, columns, least", [("estate_coverages", 8, 200), ("estate_claims_and_lines", 22, 900), ("estate_partner_lab_feed", 13, 15)])
def test_the_estate_comes_by_its_rows(spark, name, columns, least):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == columns and df.count() >= least


def test_values_above_a_few_kilobytes_are_not_broadcast(spark):
    from veilspark.operators import gates as G

    texts = spark.range(3000).selectExpr("id", "concat('Customer#', lpad(CAST(id AS STRING), 9, '0'), IF(id % 2 = 0, '!', '')) AS text")
    found = G.leaks(texts, "text", texts.where("id < 2000").selectExpr("rtrim('!', text) AS v"), "v")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2000


def test_the_digest_of_a_cell_is_computed_once(spark):
    from pyspark.sql import functions as F

    from veilspark.operators import masking as M

    df = spark.createDataFrame([("aZ9-é",), ("",), (None,)], "c string")
    out = df.select(M.same_shape(F.col("c"), M.Masker(b"k", hidden=False).digest(F.col("c"), "s")).alias("m"))
    assert out._jdf.queryExecution().analyzed().toString().count("sha2(") == 2
    assert [r.m if r.m is None else len(r.m) for r in out.collect()] == [5, 0, None]


def test_the_driver_does_not_fit(spark, monkeypatch):
    from veilspark.llm import quality_classifier as Q

    driver, real = os.getpid(), Q.fit

    def fit(*args):
        assert os.getpid() != driver
        return real(*args)

    monkeypatch.setattr(Q, "fit", fit)
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad junk ") * 30) for i in range(60)], "doc_id long, text string")
    model = Q.learn(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality"))
    assert model is not None and all(v is not None for v in model.p.values())
    assert Q.learn(docs, docs.selectExpr("doc_id", "CAST(NULL AS INT) AS quality")) is None
