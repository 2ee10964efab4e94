"""Profiling and classification of columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Detectors by column name, with category, confidence and, for two, a pattern of values.
DETECTORS = [
    ("ssn", "direct_identifier", 0.95, r"(^|_)ssn(_|$)|social_security", r"^\d{3}-?\d{2}-?\d{4}$"),
    ("email", "direct_identifier", 0.95, r"e[-_]?mail", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("phone", "direct_identifier", 0.85, r"phone|fax|mobile|telephone", None),
    ("person_name", "direct_identifier", 0.9, r"(^|_)(first|last|middle|full|patient|member)_name$", None),
    ("medical_record_number", "direct_identifier", 0.95, r"\bmrn\b|medical_record", None),
    ("member_identifier", "direct_identifier", 0.9, r"^(member_id|patient_id|subscriber_id|pat_id|mbr_id)$", None),
    ("account_number", "direct_identifier", 0.85, r"group_number|account_number|policy_number", None),
    ("npi", "pii", 0.7, r"\bnpi\b", None),
    ("operational_metadata", "non_sensitive", 0.65, r"extract_batch|source_extracted_at|delivered_at|delivered_dt|late_arrival|schema_version|row_version|batch_id", None),
    ("transaction_identifier", "quasi_identifier", 0.75, r"(^|_)(coverage|claim|claim_line|prescription|encounter|lab_result|address)_id$", None),
    ("date", "quasi_identifier", 0.6, r"_date$|^date_|dob|birth|_dt$|_at$", None),
    ("zip", "quasi_identifier", 0.85, r"zip", None),
    ("city", "quasi_identifier", 0.75, r"^city$|city_name", None),
    ("clinical_code", "phi", 0.75, r"diagnos|procedure|ndc|drug_name|test_cd|test_code|test_nm|test_name|^result$|result_value|abnormal", None),
    ("financial_amount", "sensitive", 0.7, r"amount|charge|billed|allowed|paid", None),
]
# Tier, masking strategy, retention by category or tier; data sets kept for reference.
TIER = {"direct_identifier": "direct_identifier", "quasi_identifier": "quasi_identifier", "phi": "sensitive_clinical_attribute", "pii": "quasi_identifier", "sensitive": "sensitive_clinical_attribute", "non_sensitive": "non_sensitive"}
STRATEGY = {"direct_identifier": "deterministic_tokenization", "quasi_identifier": "generalization", "sensitive_clinical_attribute": "synthetic_replacement", "non_sensitive": "passthrough"}
RETENTION = {"direct_identifier": "extended", "phi": "extended", "quasi_identifier": "standard", "pii": "standard", "sensitive": "standard", "non_sensitive": "ephemeral"}
REFERENCE = ("plan", "diagnosis", "procedure", "pharmacy", "provider")
#: Code tables under another name are kept for reference too.
CODE_TABLES = ("code",)
NPI_ENTITIES, NPI_BOOST, DEFAULT = ("provider", "pharmacy"), 0.95, ("sensitive", 0.3)


def detectors_of(column: str, entity: str = "") -> list[tuple[str, str, float]]:
    """(detector, category, confidence) of every detector whose name pattern fires."""
    found = [(d, c, x) for d, c, x, p, _ in DETECTORS if re.search(p, column, re.IGNORECASE)]
    return [(d, c, NPI_BOOST if d == "npi" and entity.strip().lower() in NPI_ENTITIES else x) for d, c, x in found]


def classify(entity: str, column: str, values_hit: set[str] = frozenset(), rules: dict | None = None, overrides: dict | None = None) -> tuple[str, float, str]:
    """(category, confidence, layer): override, else schema rule, else best detector, else the cautious default."""
    if overrides and (entity, column) in overrides:
        return overrides[entity, column], 1.0, "override"
    if rules and (entity, column) in rules:
        return rules[entity, column], 1.0, "schema"
    found = detectors_of(column, entity) + [(d, c, x) for d, c, x, _, v in DETECTORS if v and d in values_hit]
    if found:
        best = max(found, key=lambda f: f[2])
        return best[1], best[2], "pattern"
    return (*DEFAULT, "default")


def retention(dataset: str, category: str) -> str:
    return "persistent_reference" if dataset in REFERENCE + CODE_TABLES else RETENTION[category]


def value_hits(df: DataFrame) -> DataFrame:
    """column_name, detector, n_values, n_hits: value patterns over all rows of all text columns, in one pass."""
    texts = [c for c, t in df.dtypes if t == "string"]
    checks = [(c, d, p) for c in texts for d, _, _, _, p in DETECTORS if p]
    sums = df.agg(*(F.count(c).alias(f"n{i}") for i, (c, _, _) in enumerate(checks)), *(F.count_if(F.col(c).rlike(p)).alias(f"h{i}") for i, (c, _, p) in enumerate(checks)))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(d).alias("detector"), F.col(f"n{i}").alias("n_values"), F.col(f"h{i}").alias("n_hits")) for i, (c, d, _) in enumerate(checks)))))


def samples(df: DataFrame, key: str, columns: list[str], rows: int = 200, n: int = 5) -> DataFrame:
    """column_name and the first ``n`` non-null values, by key, of the first ``rows`` rows."""
    head = df.orderBy(key).limit(rows)
    lists = head.agg(*(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(key).alias("k"), F.col(c).cast("string").alias("v"))))).alias(c) for c in columns))
    texts = [F.struct(F.lit(c).alias("column_name"), F.array_join(F.transform(F.slice(c, 1, n), lambda x: x["v"]), "|").alias("samples")) for c in columns]
    return lists.select(F.inline(F.array(*texts)))


def counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and its non-null values, for every column in one pass."""
    sums = df.agg(*(F.count(c).alias(c) for c in columns))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_values")) for c in columns))))


def numeric_profile(df: DataFrame, column: str, side: str) -> DataFrame:
    """n, mean and non-zero values of one column."""
    c = F.col(column).cast("double")
    return df.agg(F.count(c).alias(f"{side}_n"), (F.sum(F.round(c * 100).cast("long")) / 100 / F.count(c)).alias(f"{side}_mean"), F.count_if(c != 0).alias(f"{side}_nonzero"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def labelled(df: DataFrame, **names: str) -> DataFrame:
    cols: dict[str, Column] = {k: F.lit(v) for k, v in names.items()}
    return df.withColumns(cols)
