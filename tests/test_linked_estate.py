"""The linked estate: columns, keys, exact rates, determinism."""

import pytest
from pyspark.sql import functions as F

from veilspark.operators import linked_estate as L

#: Columns of every entity, as the sources have them.
COLUMNS = {
    "member": "member_id first_name last_name date_of_birth gender ssn medical_record_number effective_date term_date is_active row_version extract_batch_id",
    "member_demographics": "member_id middle_name race ethnicity preferred_language marital_status email phone",
    "address": "address_id member_id address_type line1 line2 city state zip_code country effective_date",
    "plan": "plan_id plan_name plan_type metal_tier market_segment",
    "coverage": "coverage_id member_id plan_id group_number effective_date term_date coverage_status row_version",
    "provider": "provider_id npi provider_name provider_type specialty city state is_active",
    "diagnosis": "diagnosis_code description code_system",
    "procedure": "procedure_code description code_system",
    "claim": "claim_id member_id coverage_id provider_id claim_type status service_date submitted_date adjudicated_date billed_amount allowed_amount paid_amount source_extracted_at extract_batch_id",
    "claim_line": "claim_line_id claim_id line_number diagnosis_code procedure_code units charge_amount allowed_amount paid_amount revenue_code",
    "pharmacy": "pharmacy_id pharmacy_name chain_name city state zip_code npi",
    "prescription": "prescription_id member_id pharmacy_id prescriber_provider_id ndc_code drug_name days_supply quantity fill_date refill_number status",
    "encounter": "encounter_id member_id provider_id encounter_type admit_date discharge_date facility_name status source_extracted_at",
    "lab_result": "lab_result_id encounter_id member_id test_code test_name result_value result_unit reference_range abnormal_flag collected_date resulted_date source schema_version",
}


@pytest.fixture(scope="module", params=["tiny", "developer"])
def made(spark, request):
    estate = L.LinkedEstate(spark, L.SCALES[request.param], 20240101)
    frames = {n: df.persist() for n, df in estate.frames().items()}
    return estate, frames


def test_columns(made):
    assert {n: " ".join(df.columns) for n, df in made[1].items()} == COLUMNS


def test_sizes_and_keys(made):
    estate, f = made
    s = estate.scale
    assert f["member"].count() == s.members + L.hits(s.members, 0.02) == estate.people
    assert [f[n].count() for n in ("plan", "provider", "pharmacy", "diagnosis", "procedure")] == [s.plans, s.providers, s.pharmacies, s.diagnoses, s.procedures]
    keys = {"member": "member_id", "address": "address_id", "coverage": "coverage_id", "claim_line": "claim_line_id", "prescription": "prescription_id", "encounter": "encounter_id", "lab_result": "lab_result_id", "plan": "plan_id", "provider": "provider_id", "diagnosis": "diagnosis_code", "procedure": "procedure_code", "pharmacy": "pharmacy_id"}
    for n, k in keys.items():
        assert f[n].count() == f[n].select(k).distinct().count() > 0, n
    for n, digits in (("coverage", 6), ("prescription", 7), ("encounter", 7)):  # numbers without a gap through all members
        numbers = sorted(int(r[0].rsplit("-", 1)[1]) for r in f[n].select(keys[n]).collect())
        assert numbers == list(range(1, len(numbers) + 1))


def test_links_resolve_except_for_the_planted_share(made):
    estate, f = made
    found = {(r.child, r.key): (r.n_rows, r.n_unresolved) for r in L.unresolved(f).collect()}
    for child, key in (("coverage", "member_id"), ("coverage", "plan_id"), ("member_demographics", "member_id"), ("claim_line", "procedure_code"), ("prescription", "pharmacy_id"), ("prescription", "prescriber_provider_id"), ("encounter", "member_id"), ("lab_result", "encounter_id")):
        assert found[child, key][1] == 0, (child, key)
    for child, key in (("address", "member_id"), ("claim", "member_id"), ("claim", "provider_id"), ("claim_line", "claim_id"), ("claim_line", "diagnosis_code"), ("prescription", "member_id"), ("encounter", "provider_id"), ("lab_result", "member_id")):
        n, lost = found[child, key]
        assert 0 < lost < 0.5 * n, (child, key)
    assert found["address", "member_id"][1] == L.hits(estate.scale.members, 0.02)
    assert found["claim_line", "claim_id"][1] == max(1, int(f["claim"].count() * 0.02))


def test_rates_are_exact(made):
    estate, f = made
    m, p = estate.scale.members, estate.people
    got = {(r.entity, r.edge_case): r.n for r in estate.planted().collect()}
    twins = L.hits(m, 0.02)
    assert got["member", "duplicate_person"] == twins
    assert L.hits(m, 0.06) <= got["member", "null_birth_date"] <= L.hits(m, 0.06) + twins
    assert got["member_demographics", "without"] == L.hits(m, 0.05) and 0 < got["member_demographics", "malformed_phone"] <= L.hits(m, 0.03)
    assert got["address", "orphan_member"] == L.hits(m, 0.02) and got["address", "malformed_zip"] == L.hits(m, 0.03)
    assert got["coverage", "members_without"] == L.hits(p, 0.05)
    rates = {"orphan_member": 0.02, "orphan_provider": 0.02, "malformed": 0.03, "late": 0.04, "no_lines": 0.05, "twice": 0.015}
    assert {c: got["claim", f"members_{c}"] for c in rates} == {c: L.hits(p, r) for c, r in rates.items()}
    assert (got["prescription", "members_orphan"], got["prescription", "members_null_prescriber"]) == (L.hits(p, 0.02), L.hits(p, 0.06))
    assert [got["encounter", f"members_{c}"] for c in ("orphan", "malformed", "late")] == [L.hits(p, r) for r in (0.02, 0.03, 0.04)]
    partner = max(1, p // 10)
    assert got["lab_result", "not_enrolled"] == -(-partner // 5) and got["lab_result", "old_shape"] == -(-partner // 3)


def test_values(made):
    _, f = made
    assert f["claim"].where("billed_amount < 50 OR billed_amount > 15000 OR allowed_amount > billed_amount OR status = 'denied' AND allowed_amount IS NOT NULL").count() == 0
    assert f["claim"].where("paid_amount < 0").count() > 0 and f["prescription"].where("quantity < 0").count() > 0
    assert f["claim"].where("submitted_date <= service_date OR adjudicated_date <= submitted_date").count() == 0
    assert f["claim"].count() > f["claim"].distinct().count()
    lines = f["claim_line"].groupBy("claim_id").agg(F.count("*").alias("n"), F.max("line_number").alias("last"))
    assert lines.where("n <> last").count() == 0


def test_one_seed_one_estate(spark):
    a, b, c = (L.LinkedEstate(spark, L.SCALES["tiny"], seed) for seed in (7, 7, 8))
    for n in ("member", "claim", "lab_result"):
        rows = [sorted(map(tuple, x.frames()[n].repartition(k).collect()), key=repr) for k, x in ((1, a), (5, b), (1, c))]
        assert rows[0] == rows[1] != rows[2]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_hits_are_exact_for_any_number(spark, n):
    estate = L.LinkedEstate(spark, L.SCALES["tiny"], 3)
    for case in ("a", "b", "c"):
        for rate in (0.0, 0.015, 0.5, 1.0):
            assert spark.range(n).select(F.col("id").alias("i")).where(estate.hit(case, n, rate)).count() == L.hits(n, rate)
    a, b = L.permutation(n, 3, "a")
    assert sorted((a * i + b) % n for i in range(n)) == list(range(n))
