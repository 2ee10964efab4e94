"""Every column of the linked estate has a rule; rules, overrides and detectors in their order."""

from veilspark.operators import certification as X
from veilspark.operators import linked_estate as L
from veilspark.operators import profile as D
from veilspark.operators import rules as R
from veilspark.operators import schema_rules as S


def test_every_column_of_every_entity_has_one_rule(spark):
    frames = L.LinkedEstate(spark, L.SCALES["tiny"], 1).frames()
    assert {e: [c for c, _ in rules] for e, rules in S.SCHEMA.items()} == {e: df.columns for e, df in frames.items()}
    assert {k for rules in S.SCHEMA.values() for _, k in rules} <= set(D.TIER)
    assert all(r.reason for r in S.table(spark).collect())


def test_a_code_is_clinical_on_a_claim_line_only():
    assert dict(S.SCHEMA["claim_line"])["diagnosis_code"] == "phi" and dict(S.SCHEMA["diagnosis"])["diagnosis_code"] == "non_sensitive"


def test_layers_in_order_with_reasons(spark):
    columns = spark.createDataFrame([("provider", "specialty", "enrollment"), ("provider", "specialty", "partner"), ("provider", "npi", "enrollment"), ("x", "home_phone", "enrollment"), ("x", "blob", "enrollment")], "entity string, column_name string, source string")
    got = {(r.entity, r.column_name, r.source): r for r in R.classify(columns, S.table(spark), S.overrides(spark)).collect()}
    top = got["provider", "specialty", "enrollment"]
    assert (top.category, top.layer, top.confirmed_by, top.confidence) == ("sensitive", "override", "steward", 1.0) and top.reason
    assert (got["provider", "specialty", "partner"].layer, got["provider", "specialty", "partner"].category) == ("schema", "non_sensitive")
    assert got["provider", "npi", "enrollment"].category == "pii" and got["provider", "npi", "enrollment"].confirmed_by is None
    assert (got["x", "home_phone", "enrollment"].layer, got["x", "home_phone", "enrollment"].reason) == ("pattern", "detector phone")
    assert (got["x", "blob", "enrollment"].layer, got["x", "blob", "enrollment"].confidence) == ("default", 0.3)


def test_classes_of_the_linked_estate(spark):
    """Schema rules leave nothing to detectors; without them, detectors find what names and values show."""
    frames = {e: df for e, df in L.LinkedEstate(spark, L.SCALES["tiny"], 1).frames().items() if e in ("member", "member_demographics")}
    profiled = X.profile(frames, {})
    none = S.overrides(spark).where("false")
    assert {r.layer for r in R.classify(profiled, S.table(spark), none, X.value_detections(profiled)).collect()} == {"schema"}
    bare = {(r.entity, r.column_name): r for r in R.classify(profiled.withColumnRenamed("source", "origin"), S.table(spark).where("false"), none.drop("source"), X.value_detections(profiled)).collect()}
    assert bare["member", "ssn"].category == "direct_identifier" and bare["member_demographics", "email"].category == "direct_identifier" and bare["member_demographics", "race"].layer == "default"
