"""Schema rules: the category of every column of the fourteen entities, and why.

These come before any detector: a column that is a field of a known entity has its
category from here.  The same name can mean other things elsewhere, so rules go by
entity and column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Category of every column, by entity, in the order of the entity's columns.
SCHEMA: dict[str, list[tuple[str, str]]] = {
    "member": [("member_id", "direct_identifier"), ("first_name", "direct_identifier"), ("last_name", "direct_identifier"), ("date_of_birth", "quasi_identifier"), ("gender", "quasi_identifier"), ("ssn", "direct_identifier"), ("medical_record_number", "direct_identifier"), ("effective_date", "quasi_identifier"), ("term_date", "quasi_identifier"), ("is_active", "non_sensitive"), ("row_version", "non_sensitive"), ("extract_batch_id", "non_sensitive")],
    "member_demographics": [("member_id", "direct_identifier"), ("middle_name", "direct_identifier"), ("race", "quasi_identifier"), ("ethnicity", "quasi_identifier"), ("preferred_language", "quasi_identifier"), ("marital_status", "quasi_identifier"), ("email", "direct_identifier"), ("phone", "direct_identifier")],
    "address": [("address_id", "quasi_identifier"), ("member_id", "direct_identifier"), ("address_type", "non_sensitive"), ("line1", "direct_identifier"), ("line2", "direct_identifier"), ("city", "quasi_identifier"), ("state", "non_sensitive"), ("zip_code", "quasi_identifier"), ("country", "non_sensitive"), ("effective_date", "quasi_identifier")],
    "plan": [("plan_id", "non_sensitive"), ("plan_name", "non_sensitive"), ("plan_type", "non_sensitive"), ("metal_tier", "non_sensitive"), ("market_segment", "non_sensitive")],
    "coverage": [("coverage_id", "quasi_identifier"), ("member_id", "direct_identifier"), ("plan_id", "non_sensitive"), ("group_number", "direct_identifier"), ("effective_date", "quasi_identifier"), ("term_date", "quasi_identifier"), ("coverage_status", "non_sensitive"), ("row_version", "non_sensitive")],
    "provider": [("provider_id", "pii"), ("npi", "pii"), ("provider_name", "pii"), ("provider_type", "non_sensitive"), ("specialty", "non_sensitive"), ("city", "non_sensitive"), ("state", "non_sensitive"), ("is_active", "non_sensitive")],
    "diagnosis": [("diagnosis_code", "non_sensitive"), ("description", "non_sensitive"), ("code_system", "non_sensitive")],
    "procedure": [("procedure_code", "non_sensitive"), ("description", "non_sensitive"), ("code_system", "non_sensitive")],
    "claim": [("claim_id", "quasi_identifier"), ("member_id", "direct_identifier"), ("coverage_id", "quasi_identifier"), ("provider_id", "pii"), ("claim_type", "non_sensitive"), ("status", "non_sensitive"), ("service_date", "quasi_identifier"), ("submitted_date", "quasi_identifier"), ("adjudicated_date", "quasi_identifier"), ("billed_amount", "sensitive"), ("allowed_amount", "sensitive"), ("paid_amount", "sensitive"), ("source_extracted_at", "non_sensitive"), ("extract_batch_id", "non_sensitive")],
    "claim_line": [("claim_line_id", "quasi_identifier"), ("claim_id", "quasi_identifier"), ("line_number", "non_sensitive"), ("diagnosis_code", "phi"), ("procedure_code", "phi"), ("units", "non_sensitive"), ("charge_amount", "sensitive"), ("allowed_amount", "sensitive"), ("paid_amount", "sensitive"), ("revenue_code", "non_sensitive")],
    "pharmacy": [("pharmacy_id", "non_sensitive"), ("pharmacy_name", "non_sensitive"), ("chain_name", "non_sensitive"), ("city", "non_sensitive"), ("state", "non_sensitive"), ("zip_code", "non_sensitive"), ("npi", "pii")],
    "prescription": [("prescription_id", "quasi_identifier"), ("member_id", "direct_identifier"), ("pharmacy_id", "non_sensitive"), ("prescriber_provider_id", "pii"), ("ndc_code", "phi"), ("drug_name", "phi"), ("days_supply", "phi"), ("quantity", "phi"), ("fill_date", "quasi_identifier"), ("refill_number", "non_sensitive"), ("status", "non_sensitive")],
    "encounter": [("encounter_id", "quasi_identifier"), ("member_id", "direct_identifier"), ("provider_id", "pii"), ("encounter_type", "phi"), ("admit_date", "quasi_identifier"), ("discharge_date", "quasi_identifier"), ("facility_name", "quasi_identifier"), ("status", "non_sensitive"), ("source_extracted_at", "non_sensitive")],
    "lab_result": [("lab_result_id", "quasi_identifier"), ("encounter_id", "quasi_identifier"), ("member_id", "direct_identifier"), ("test_code", "phi"), ("test_name", "phi"), ("result_value", "phi"), ("result_unit", "non_sensitive"), ("reference_range", "non_sensitive"), ("abnormal_flag", "phi"), ("collected_date", "quasi_identifier"), ("resulted_date", "quasi_identifier"), ("source", "non_sensitive"), ("schema_version", "non_sensitive")],
}
#: Why a column has its category, unless a name in WHY says it better.
REASONS = {"direct_identifier": "names one person by itself", "quasi_identifier": "narrows down to a person together with others", "phi": "a clinical fact of one person", "pii": "identifies a provider, not a patient", "sensitive": "an amount of money", "non_sensitive": "neither identifying nor clinical"}
WHY = {"member_id": "links all rows of one member in all sources", "ssn": "social security number", "email": "email address", "phone": "phone number", "line1": "street address", "line2": "street address", "group_number": "account number of a plan", "medical_record_number": "medical record number", "npi": "identifies a provider, not a patient", "extract_batch_id": "metadata of the extract", "row_version": "metadata of the extract", "source_extracted_at": "metadata of the extract", "schema_version": "metadata of the extract"}
#: Overrides by source, entity and column, with who confirmed them.
OVERRIDES = [("enrollment", "provider", "specialty", "sensitive", "some specialties tell of their patients", "steward"), ("claims", "claim", "adjustment_reason_code", "non_sensitive", "a code of the process", "steward")]


def reason(column: str, category: str) -> str:
    return WHY.get(column, REASONS[category])


def table(spark: SparkSession) -> DataFrame:
    """entity, column_name, category, reason of every rule."""
    return spark.createDataFrame([(e, c, k, reason(c, k)) for e, rules in SCHEMA.items() for c, k in rules], "entity string, column_name string, category string, reason string")


def overrides(spark: SparkSession) -> DataFrame:
    """source, entity, column_name, category, reason, confirmed_by of every override."""
    return spark.createDataFrame(OVERRIDES, "source string, entity string, column_name string, category string, reason string, confirmed_by string")
