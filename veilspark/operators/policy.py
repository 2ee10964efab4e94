"""Masking policy: which technique, field type and scope a column gets.

Rules are resolved once per column on the driver (columns are metadata), so a table is
masked by one projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Linkage scopes by column alias.
SCOPES = {
    "member-id-global": ("member_id", "patient_id", "subscriber_id", "pat_id", "mbr_id"),
    "provider-id-global": ("provider_id", "prescriber_provider_id"),
    "coverage-id-global": ("coverage_id",),
    "claim-id-global": ("claim_id",),
    "claim-line-id-global": ("claim_line_id",),
    "encounter-id-global": ("encounter_id",),
    "prescription-id-global": ("prescription_id",),
    "lab-result-id-global": ("lab_result_id",),
    "address-id-global": ("address_id",),
}
# Field type by column name, first match wins.
FIELD_TYPES = [
    ("ssn", r"(^|_)ssn(_|$)|social_security"),
    ("email", r"e[-_]?mail"),
    ("phone", r"phone|fax|mobile|telephone"),
    ("first_name", r"(^|_)first_name$"),
    ("last_name", r"(^|_)last_name$"),
    ("full_name", r"(^|_)(middle|full|patient|member|provider|prescriber|pharmacy)_name$"),
    ("zip_code", r"zip"),
    ("city", r"^city$|city_name"),
    ("street_address", r"(^|_)line1$|(^|_)line2$|street|address_line"),
    ("identifier", r"^(member_id|patient_id|subscriber_id|pat_id|mbr_id)$|(^|_)(coverage|claim|claim_line|prescription|encounter|lab_result|address|provider|pharmacy|plan)_id$|\bnpi\b|medical_record|\bmrn\b|group_number|account_number|policy_number"),
    ("date", r"_date$|^date_|dob|birth|_dt$"),
    ("numeric", r"amount|charge|billed|allowed|paid|quantity|units|days_supply"),
]
# Technique by column name for the protected tiers, first match wins.
FIELD_RULES = [
    (r"(^|_)ssn(_|$)", "format_preserving_synthetic", "ssn"),
    (r"e[-_]?mail", "email_mask", "email"),
    (r"phone|fax|mobile|telephone", "phone_mask", "phone"),
    (r"^first_name$", "name_replacement", "first_name"),
    (r"^last_name$", "name_replacement", "last_name"),
    (r"(^|_)(middle|full|patient|member)_name$", "name_replacement", "full_name"),
    (r"(^|_)line1$|(^|_)line2$", "address_replacement", "street_address"),
    (r"^city$|city_name", "address_replacement", "city"),
    (r"zip", "address_replacement", "zip_code"),
    (r"\bmrn\b|medical_record", "format_preserving_synthetic", "identifier"),
    (r"group_number|account_number|policy_number", "format_preserving_synthetic", "generic"),
    (r"_date$|^date_|dob|birth|_dt$|fill_date|admit_date|discharge_date|collected_date|resulted_date|service_date|submitted_date|adjudicated_date|effective_date|term_date", "date_shift", "date"),
]
# Fallback technique and scope by tier.
FALLBACK = {
    "direct_identifier": ("hmac_pseudonymization", "direct-identifier-default"),
    "quasi_identifier": ("date_shift", "quasi-identifier-default"),
    "sensitive_clinical_attribute": ("format_preserving_synthetic", "sensitive-clinical-default"),
    "non_sensitive": ("passthrough", "non-sensitive-default"),
}


@dataclass(frozen=True)
class Rule:
    technique: str
    field_type: str
    scope: str


def infer_field_type(column: str) -> str:
    return next((t for t, p in FIELD_TYPES if re.search(p, column, re.IGNORECASE)), "generic")


def linkage_scope(column: str) -> str | None:
    return next((s for s, names in SCOPES.items() if column.lower() in names), None)


def resolve(tier: str | None, column: str) -> Rule:
    """The rule of a column; one that the catalog lacks is pseudonymised under a scope of its own."""
    if tier is None:
        return Rule("hmac_pseudonymization", infer_field_type(column), f"unclassified:{column}")
    technique, scope = FALLBACK[tier]
    if technique == "passthrough":
        return Rule(technique, infer_field_type(column), scope)
    if linked := linkage_scope(column):
        return Rule("tokenization", "identifier", linked)
    for pattern, own, kind in FIELD_RULES:
        if re.search(pattern, column, re.IGNORECASE):
            return Rule(own, infer_field_type(column) if kind == "generic" else kind, scope)
    return Rule(technique, infer_field_type(column), scope)
