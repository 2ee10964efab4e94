"""A certification run, each of its gates broken in turn, and its publication."""

import dataclasses
import os
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from veilspark.operators import certification as X
from veilspark.operators import closure as C
from veilspark.plans import certification_queries as Q
from veilspark.plans.base import entity, names
from veilspark.sources import pointer

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")
TERMS = X.Terms(secrets=Q.SECRETS)


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("certified"))
    run, gates, status = Q.certified(spark, SF, TERMS, root, scenarios=Q.scenario(spark, SF))
    return root, run, gates.collect(), status


@pytest.fixture
def copy(whole, tmp_path):
    """The run in a folder of its own, to be broken."""
    folder = str(tmp_path / uuid.uuid4().hex)
    shutil.copytree(whole[1].folder, folder)
    return X.opened(whole[1], folder)


def failed(run):
    return sorted(r.gate for r in X.judge(run).collect() if not r.passed)


def changed(run, spark, name, make):
    """Replace one final table on disk."""
    path = f"{run.folder}/final/{name}"
    rows = make(run.final[name]).collect()
    schema = make(run.final[name]).schema
    shutil.rmtree(path)
    spark.createDataFrame(rows, schema).write.parquet(path)
    return X.opened(run, run.folder)


def test_a_sound_run_is_certified_and_published(spark, whole):
    root, run, gates, status = whole
    assert len(gates) == 12 and all(g.passed for g in gates) and status == "certified"
    assert pointer.read(spark, root) == run.folder
    seen = X.published(spark, root)
    assert set(seen) == set(Q.ESTATE) and all(seen[n].columns[: len(names(n))] for n in seen)
    assert seen["claim"].where("data_provenance = 'synthetic'").count() == entity(spark, SF, "plan").count()
    record = {r.entity: r for r in run.read(spark, "manifests/masking").collect()}
    assert set(record) == set(Q.ESTATE)
    for name, r in record.items():
        assert r.n_rows == run.subset[name].count() and sum(r.techniques.values()) == r.n_rows * len(names(name)) and r.n_files > 0 and r.validation_passed
    assert record["member"].n_warnings == record["member"].n_rows  # its segment is no date
    raw = {r.name for r in entity(spark, SF, "member").select("name").collect()}
    assert not raw & {r.name for r in seen["member"].select("name").collect()}


def test_catalog_of_the_run_decides_the_masking(spark, whole):
    run = whole[1]
    rules = {(r.entity, r.column_name): r.technique for r in run.resolved.collect()}
    assert rules["claim", "member_id"] == "tokenization" and rules["claim", "status"] == "passthrough" and rules["member", "name"] == "hmac_pseudonymization"
    assert run.catalog.where("owner IS NULL OR tier IS NULL").count() == 0
    assert {r.status for r in run.final["claim"].where("scenario_type IS NULL").select("status").distinct().collect()} <= {"paid", "pending", "denied"}


def test_value_detectors_reach_the_catalog(spark, tmp_path):
    df = spark.createDataFrame([("123-45-6789", "x"), (None, "a@b.org")], "code_a string, code_b string")
    run = X.Run(str(tmp_path), {"t": "s"}, Q.MASKER, TERMS)
    none = spark.createDataFrame([], "entity string, column_name string, category string")
    X.classify(run, {"t": df}, none, none, spark.createDataFrame([("s", "o")], "source string, owner string"))
    assert {(r.column_name, r.category, r.layer) for r in run.catalog.collect()} == {("code_a", "direct_identifier", "pattern"), ("code_b", "direct_identifier", "pattern")}


def test_policy_coverage(copy):
    copy.resolved = copy.resolved.withColumn("technique", F.when(F.col("column_name") == "member_id", "passthrough").otherwise(F.col("technique")))
    assert failed(copy) == ["phi_pii_policy_coverage"]


def test_masking_completion(spark, copy):
    """Raw ids instead of tokens in one table: no selected value gives them."""
    copy.scenarios = {}
    copy.final["coverage"] = copy.subset["coverage"]
    X.validate(copy)
    found = {r.check_name: r.n_findings for r in copy.read(spark, "validation").collect()}
    assert found["foreign"] > 0
    copy.final["member"] = copy.subset["member"]
    X.validate(copy)
    found = {r.check_name: r.n_findings for r in copy.read(spark, "validation").collect()}
    assert found["leaks"] > 0
    whole = X.opened(copy, copy.folder)
    assert "masking_completion" in failed(whole)


def test_referential_integrity_and_strictness(spark, copy):
    lost = copy.subset | {"claim": copy.subset["claim"].limit(1)}
    named = {h.name: lost[h.entity] for h in C.HOPS} | lost
    copy.dangling = copy.put(C.dangling(named, copy.source), "dangling-again")
    assert copy.dangling.where("category = 'engine_bug'").count() > 0
    assert failed(copy) == ["referential_integrity"]
    copy.dangling = spark.createDataFrame([("claim.provider_id", 7, "source_orphan")], "relationship string, id long, category string")
    assert failed(copy) == []
    copy.terms = dataclasses.replace(TERMS, strict=True)
    assert failed(copy) == ["referential_integrity"]


def test_schema_validation(spark, copy):
    more = changed(copy, spark, "address", lambda df: df.unionByName(df.limit(1)).withColumn("address_id", F.concat("address_id", F.lit(""))))
    assert failed(more) == ["provenance", "schema_validation"]


def test_a_file_of_another_shape(spark, copy):
    copy.final["address"].limit(0).withColumn("surplus", F.lit(1)).coalesce(1).write.mode("append").parquet(f"{copy.folder}/final/address")
    assert failed(X.opened(copy, copy.folder)) == ["schema_validation"]


def test_data_quality(copy):
    copy.terms = dataclasses.replace(TERMS, least_rows=10**9)
    assert failed(copy) == ["data_quality_thresholds"]
    copy.terms = dataclasses.replace(TERMS, anchor="nobody")
    assert failed(copy) == ["data_quality_thresholds"]


def test_row_count_reconciliation(spark, copy):
    fewer = changed(copy, spark, "claim_line", lambda df: df.limit(1))
    assert failed(fewer) == ["provenance", "row_count_reconciliation", "schema_validation"]


def test_orphan_detection(spark, copy):
    copy.terms = dataclasses.replace(TERMS, most_orphans=1)
    copy.dangling = spark.createDataFrame([("claim.provider_id", i, "source_orphan") for i in (7, 8)], "relationship string, id long, category string")
    assert failed(copy) == ["orphan_detection"]


def test_provenance(spark, copy):
    tags = copy.read(spark, "manifests/synthetic").where("data_provenance <> 'synthetic'").collect()
    shutil.rmtree(f"{copy.folder}/manifests/synthetic")
    copy.put(spark.createDataFrame(tags, "entity string, data_provenance string, n long"), "manifests/synthetic")
    assert failed(copy) == ["provenance"]


@pytest.mark.parametrize("name", ["subset", "masking", "synthetic"])
def test_manifest_generation(copy, name):
    shutil.rmtree(f"{copy.folder}/manifests/{name}")
    assert "manifest_generation" in failed(copy)


def test_versions(spark, whole, copy):
    record = copy.read(spark, "manifests/masking").collect()
    for field, value, gate in (("policy_name", "", "policy_version_recorded"), ("policy_version", 0, "policy_version_recorded"), ("engine_version", " ", "masking_version_recorded")):
        shutil.rmtree(f"{copy.folder}/manifests/masking")
        copy.put(spark.createDataFrame([r.asDict() | {field: value} for r in record], X.RECORD), "manifests/masking")
        assert failed(copy) == [gate]


def test_distribution_shape(spark, copy):
    far = changed(copy, spark, "claim", lambda df: df.withColumn("billed", F.col("billed") * 1000))
    assert failed(far) == ["distribution_shape"]
    flat = changed(far, spark, "claim", lambda df: df.withColumn("billed", F.lit(0.0)))
    assert failed(flat) == ["distribution_shape"]


def test_a_failed_run_leaves_what_readers_see(spark, whole):
    root, run, _, _ = whole
    again, gates, status = Q.certified(spark, SF, dataclasses.replace(TERMS, least_rows=10**9), root)
    assert status == "failed" and pointer.read(spark, root) == run.folder != again.folder
    assert X.published(spark, root)["claim"].count() == run.final["claim"].count()
    with pytest.raises(RuntimeError):
        pointer.swap(spark, root, again.folder, expected="elsewhere")
    pointer.swap(spark, root, again.folder, expected=run.folder)
    assert pointer.read(spark, root) == again.folder
    pointer.swap(spark, root, run.folder)
    assert X.published(spark, str(root) + "-none") is None
