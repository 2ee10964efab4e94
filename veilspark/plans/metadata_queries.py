"""Rules, classification and the catalog over the columns of the estate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import certification as X
from ..operators import rules as R
from ..operators import schema_rules as S
from ..sources.shared import stash
from .base import ESTATE, WITH, entity, names, query
from .masking_queries import TIERS

SOURCES = {"enrollment": ["member", "member_demographics", "address", "coverage", "plan", "provider"], "claims": ["claim", "claim_line", "code"], "clinical": ["encounter", "lab_ehr"], "pbm": ["prescription", "pharmacy"], "partner": ["lab_partner_v1", "lab_partner_v2"]}
SOURCE_OF = {e: s for s, es in SOURCES.items() for e in es}
#: Schema rules, overrides and owners of the columns at hand.
RULES = [("member", "name", "direct_identifier"), ("member", "gender", "quasi_identifier"), ("claim", "status", "non_sensitive"), ("claim", "batch", "non_sensitive"), ("claim_line", "line_number", "non_sensitive"), ("coverage", "status", "non_sensitive")]
OVERRIDES = [("provider", "provider_name", "sensitive"), ("lab_ehr", "result", "phi")]
OWNERS = [("enrollment", "Enrollment Data Engineering"), ("claims", "Claims Data Engineering"), ("clinical", "Clinical Data Engineering"), ("pbm", "Pharmacy Benefit Management Integration"), ("partner", "Partner Integrations")]


def columns(spark, sf_dir) -> DataFrame:
    """entity, column_name, tier, n_rows, n_values, source of every column, counted in one pass over each table."""
    parts = []
    for e, tiers in TIERS.items():
        stats = entity(spark, sf_dir, e).agg(F.count("*").alias("n_rows"), F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("tier"), F.count(c).alias("n_values")) for c, t in tiers.items())).alias("x"))
        parts.append(stats.select(F.lit(e).alias("entity"), F.lit(SOURCE_OF[e]).alias("source"), "n_rows", F.inline("x")))
    return reduce(DataFrame.unionByName, parts)


def frame(spark, rows, names) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def classified(spark, sf_dir) -> DataFrame:
    names = ("entity", "column_name", "category")
    return R.classify(columns(spark, sf_dir), frame(spark, RULES, names), frame(spark, OVERRIDES, names))


def shown(df: DataFrame, resolved) -> DataFrame:
    return df.select("entity", "column_name", resolved.alias("resolved"), "n_values")


def _cols_of(e: str, tiers: dict[str, str]) -> str:
    """All columns of one entity with their counts, in SQL that reads the entity once."""
    structs = ", ".join(f"{{'column_name': '{c}', 'tier': '{t}', 'n_values': count({c})}}" for c, t in tiers.items())
    return f"SELECT '{e}' AS entity, '{SOURCE_OF[e]}' AS source, x.column_name, x.tier, n_rows, x.n_values FROM (SELECT n_rows, unnest(xs) AS x FROM (SELECT count(*) AS n_rows, [{structs}] AS xs FROM {e}))"


_COLS = "cols AS MATERIALIZED (" + " UNION ALL ".join(_cols_of(e, ts) for e, ts in TIERS.items()) + ")"
#: The same for all columns of the estate, without tiers.
ALL_COLS = "cols AS MATERIALIZED (" + " UNION ALL ".join(_cols_of(e, dict.fromkeys(names(e), "")) for e in ESTATE) + ")"
# The rules of operators/policy.py as a check in another engine states them.
_RULES_SQL = r"""
kinds(number, kind, pattern) AS (VALUES
 (1, 'ssn', '(^|_)ssn(_|$)|social_security'), (2, 'email', 'e[-_]?mail'), (3, 'phone', 'phone|fax|mobile|telephone'),
 (4, 'first_name', '(^|_)first_name$'), (5, 'last_name', '(^|_)last_name$'),
 (6, 'full_name', '(^|_)(middle|full|patient|member|provider|prescriber|pharmacy)_name$'),
 (7, 'zip_code', 'zip'), (8, 'city', '^city$|city_name'), (9, 'street_address', '(^|_)line1$|(^|_)line2$|street|address_line'),
 (10, 'identifier', '^(member_id|patient_id|subscriber_id|pat_id|mbr_id)$|(^|_)(coverage|claim|claim_line|prescription|encounter|lab_result|address|provider|pharmacy|plan)_id$|\bnpi\b|medical_record|\bmrn\b|group_number|account_number|policy_number'),
 (11, 'date', '_date$|^date_|dob|birth|_dt$'), (12, 'numeric', 'amount|charge|billed|allowed|paid|quantity|units|days_supply')),
aliases(alias, scope) AS (VALUES
 ('member_id', 'member-id-global'), ('patient_id', 'member-id-global'), ('subscriber_id', 'member-id-global'), ('pat_id', 'member-id-global'), ('mbr_id', 'member-id-global'),
 ('provider_id', 'provider-id-global'), ('prescriber_provider_id', 'provider-id-global'), ('coverage_id', 'coverage-id-global'), ('claim_id', 'claim-id-global'),
 ('claim_line_id', 'claim-line-id-global'), ('encounter_id', 'encounter-id-global'), ('prescription_id', 'prescription-id-global'), ('lab_result_id', 'lab-result-id-global'), ('address_id', 'address-id-global')),
field_rules(number, technique, pattern) AS (VALUES
 (1, 'format_preserving_synthetic', '(^|_)ssn(_|$)'), (2, 'email_mask', 'e[-_]?mail'), (3, 'phone_mask', 'phone|fax|mobile|telephone'),
 (4, 'name_replacement', '^first_name$'), (5, 'name_replacement', '^last_name$'), (6, 'name_replacement', '(^|_)(middle|full|patient|member)_name$'),
 (7, 'address_replacement', '(^|_)line1$|(^|_)line2$'), (8, 'address_replacement', '^city$|city_name'), (9, 'address_replacement', 'zip'),
 (10, 'format_preserving_synthetic', '\bmrn\b|medical_record'), (11, 'format_preserving_synthetic', 'group_number|account_number|policy_number'),
 (12, 'date_shift', '_date$|^date_|dob|birth|_dt$|fill_date|admit_date|discharge_date|collected_date|resulted_date|service_date|submitted_date|adjudicated_date|effective_date|term_date')),
fallback(tier, technique, scope) AS (VALUES
 ('direct_identifier', 'hmac_pseudonymization', 'direct-identifier-default'), ('quasi_identifier', 'date_shift', 'quasi-identifier-default'),
 ('sensitive_clinical_attribute', 'format_preserving_synthetic', 'sensitive-clinical-default'), ('non_sensitive', 'passthrough', 'non-sensitive-default'))"""
RESOLVED = """
matched AS (SELECT a.*, s.scope AS linked, f.technique AS usual, f.scope AS wide, r.technique AS ruled FROM asked a
 LEFT JOIN aliases s ON s.alias = lower(a.column_name) LEFT JOIN fallback f ON f.tier = a.tier
 LEFT JOIN (SELECT entity, column_name, arg_min(technique, number) AS technique FROM asked JOIN field_rules ON regexp_matches(column_name, pattern, 'i') GROUP BY entity, column_name) r ON r.entity = a.entity AND r.column_name = a.column_name),
resolved AS (SELECT *, CASE WHEN tier IS NULL THEN 'hmac_pseudonymization' WHEN usual = 'passthrough' THEN usual WHEN linked IS NOT NULL THEN 'tokenization' ELSE coalesce(ruled, usual) END AS technique,
 CASE WHEN tier IS NULL THEN 'unclassified:' || column_name WHEN usual = 'passthrough' OR linked IS NULL THEN wide ELSE linked END AS scope FROM matched)"""
# The detectors and tiers of operators/profile.py, stated again.
_DETECTORS_SQL = r"""
detectors(number, detector, category, confidence, pattern) AS (VALUES
 (1, 'ssn', 'direct_identifier', 0.95, '(^|_)ssn(_|$)|social_security'), (2, 'email', 'direct_identifier', 0.95, 'e[-_]?mail'), (3, 'phone', 'direct_identifier', 0.85, 'phone|fax|mobile|telephone'),
 (4, 'person_name', 'direct_identifier', 0.9, '(^|_)(first|last|middle|full|patient|member)_name$'), (5, 'medical_record_number', 'direct_identifier', 0.95, '\bmrn\b|medical_record'),
 (6, 'member_identifier', 'direct_identifier', 0.9, '^(member_id|patient_id|subscriber_id|pat_id|mbr_id)$'), (7, 'account_number', 'direct_identifier', 0.85, 'group_number|account_number|policy_number'),
 (8, 'npi', 'pii', 0.7, '\bnpi\b'), (9, 'operational_metadata', 'non_sensitive', 0.65, 'extract_batch|source_extracted_at|delivered_at|delivered_dt|late_arrival|schema_version|row_version|batch_id'),
 (10, 'transaction_identifier', 'quasi_identifier', 0.75, '(^|_)(coverage|claim|claim_line|prescription|encounter|lab_result|address)_id$'), (11, 'date', 'quasi_identifier', 0.6, '_date$|^date_|dob|birth|_dt$|_at$'),
 (12, 'zip', 'quasi_identifier', 0.85, 'zip'), (13, 'city', 'quasi_identifier', 0.75, '^city$|city_name'),
 (14, 'clinical_code', 'phi', 0.75, 'diagnos|procedure|ndc|drug_name|test_cd|test_code|test_nm|test_name|^result$|result_value|abnormal'), (15, 'financial_amount', 'sensitive', 0.7, 'amount|charge|billed|allowed|paid')),
ruled(entity, column_name, category) AS (VALUES ('member', 'name', 'direct_identifier'), ('member', 'gender', 'quasi_identifier'), ('claim', 'status', 'non_sensitive'), ('claim', 'batch', 'non_sensitive'), ('claim_line', 'line_number', 'non_sensitive'), ('coverage', 'status', 'non_sensitive')),
overridden(entity, column_name, category) AS (VALUES ('provider', 'provider_name', 'sensitive'), ('lab_ehr', 'result', 'phi')),
surest AS (SELECT entity, column_name, arg_min(category, -confidence * 1000 + number) AS category, max(confidence) AS confidence FROM cols JOIN detectors ON regexp_matches(column_name, pattern, 'i') GROUP BY entity, column_name),
classified AS MATERIALIZED (SELECT c.*, coalesce(o.category, r.category, s.category, 'sensitive') AS category,
 CASE WHEN coalesce(o.category, r.category) IS NOT NULL THEN 1.0 ELSE coalesce(s.confidence, 0.3) END AS confidence,
 CASE WHEN o.category IS NOT NULL THEN 'override' WHEN r.category IS NOT NULL THEN 'schema' WHEN s.category IS NOT NULL THEN 'pattern' ELSE 'default' END AS layer
 FROM cols c LEFT JOIN surest s ON s.entity = c.entity AND s.column_name = c.column_name LEFT JOIN ruled r ON r.entity = c.entity AND r.column_name = c.column_name LEFT JOIN overridden o ON o.entity = c.entity AND o.column_name = c.column_name),
tiers(category, tier, strategy, retention) AS (VALUES ('direct_identifier', 'direct_identifier', 'deterministic_tokenization', 'extended'), ('quasi_identifier', 'quasi_identifier', 'generalization', 'standard'), ('phi', 'sensitive_clinical_attribute', 'synthetic_replacement', 'extended'),
 ('pii', 'quasi_identifier', 'generalization', 'standard'), ('sensitive', 'sensitive_clinical_attribute', 'synthetic_replacement', 'standard'), ('non_sensitive', 'non_sensitive', 'passthrough', 'ephemeral')),
owners(source, owner) AS (VALUES ('enrollment', 'Enrollment Data Engineering'), ('claims', 'Claims Data Engineering'), ('clinical', 'Clinical Data Engineering'), ('pbm', 'Pharmacy Benefit Management Integration'), ('partner', 'Partner Integrations'))"""
POLICY = f"{WITH}, {_COLS}, {_RULES_SQL}"
_CLASSES = f"{WITH}, {_COLS}, {_DETECTORS_SQL}"


@query("infer_field_type", f"{POLICY} SELECT c.entity, c.column_name, coalesce(k.kind, 'generic') AS resolved, c.n_values FROM cols c LEFT JOIN (SELECT entity, column_name, arg_min(kind, number) AS kind FROM cols JOIN kinds ON regexp_matches(column_name, pattern, 'i') GROUP BY entity, column_name) k ON k.entity = c.entity AND k.column_name = c.column_name")
def infer_field_type(spark, sf_dir):
    return shown(R.field_types(columns(spark, sf_dir)), F.col("field_type"))


@query("linkage_scope", f"{POLICY} SELECT entity, column_name, coalesce(scope, '') AS resolved, n_values FROM cols LEFT JOIN aliases ON alias = lower(column_name)")
def linkage_scope(spark, sf_dir):
    return shown(R.linkage_scopes(columns(spark, sf_dir)), F.coalesce("linkage_scope", F.lit("")))


@query("resolve_rule", f"{POLICY}, asked AS (SELECT * FROM cols), {RESOLVED} SELECT entity, column_name, technique AS resolved, n_values FROM resolved")
def resolve_rule(spark, sf_dir):
    return shown(R.resolve(columns(spark, sf_dir)), F.col("technique"))


@query("technique_counts", f"{POLICY}, asked AS (SELECT * FROM cols), {RESOLVED} SELECT entity, technique, CAST(sum(n_rows) AS BIGINT) AS cells FROM resolved GROUP BY entity, technique")
def technique_counts(spark, sf_dir):
    """Rows of a table times its columns for each technique; no counter inside the masking."""
    return R.resolve(columns(spark, sf_dir)).groupBy("entity", "technique").agg(F.sum("n_rows").alias("cells"))


@query("catalog_lookup_join", f"{POLICY}, asked AS (SELECT * REPLACE (CASE WHEN length(column_name) % 3 <> 0 THEN tier END AS tier) FROM cols), {RESOLVED} SELECT entity, column_name, scope AS resolved, n_values FROM resolved")
def catalog_lookup_join(spark, sf_dir):
    """Columns against a written catalog that lacks some of them."""
    every = columns(spark, sf_dir)
    written = stash(every.where("length(column_name) % 3 <> 0").select("entity", "column_name", "tier"), "catalog-of-columns")
    return shown(R.look_up(every.drop("tier"), written), F.col("scope"))


#: Columns that no row of the linked estate fills.
_UNFILLED = {("member", "term_date"), ("claim", "coverage_id"), ("claim_line", "revenue_code")}
_SCHEMA_SQL = ", ".join(f"('{e}', '{c}', '{k}', '{S.reason(c, k)}')" for e, rules in S.SCHEMA.items() for c, k in rules)


@query("schema_rules", f"SELECT e AS entity, c AS column_name, k AS category, r AS reason, NOT ({' OR '.join(f'e = {chr(39)}{e}{chr(39)} AND c = {chr(39)}{c}{chr(39)}' for e, c in sorted(_UNFILLED))}) AND (SELECT count(*) FROM customer) > 0 AS filled FROM (VALUES {_SCHEMA_SQL}) v(e, c, k, r)")
def schema_rules(spark, sf_dir):
    """Every column of the fourteen entities with its rule, profiled over the linked estate at the size of the given tables."""
    from .estate_queries import made

    profiled = X.profile(made(spark, sf_dir).frames(), {})
    classes = R.classify(profiled, S.table(spark), S.overrides(spark).where("false"), X.value_detections(profiled))
    return classes.where("layer = 'schema'").select("entity", "column_name", "category", "reason", (F.col("n_values") > 0).alias("filled"))


_OVERRIDES_SQL = ", ".join(f"('{s}', '{e}', '{c}', '{k}', '{w}')" for s, e, c, k, _, w in [*S.OVERRIDES, *((SOURCE_OF[e], e, c, k, "", "steward") for e, c, k in OVERRIDES)])


@query("manual_overrides", f"{WITH}, {ALL_COLS}, given(source, entity, column_name, category, confirmed_by) AS (VALUES {_OVERRIDES_SQL}) SELECT c.source, c.entity, c.column_name, coalesce(o.category, '') AS category, o.confirmed_by, c.n_rows, c.n_values FROM cols c LEFT JOIN given o ON o.source = c.source AND o.entity = c.entity AND o.column_name = c.column_name")
def manual_overrides(spark, sf_dir):
    """Every column of the estate with what a steward has decided by source, entity and column, or nothing; those of other sources do not count."""
    given = [*((s, e, c, k, r, w) for s, e, c, k, r, w in S.OVERRIDES), *((SOURCE_OF[e], e, c, k, "reviewed", "steward") for e, c, k in OVERRIDES), ("partner", "provider", "provider_name", "non_sensitive", "of another source", "nobody")]
    every = X.profile({e: entity(spark, sf_dir, e) for e in ESTATE}, SOURCE_OF)
    decided = R.classify(every, S.table(spark).where("false"), spark.createDataFrame(given, S.overrides(spark).schema))
    category = F.when(F.col("layer") == "override", F.col("category")).otherwise("")
    return decided.select("source", "entity", "column_name", category.alias("category"), "confirmed_by", "n_rows", "n_values")


@query("npi_entity_boost", f"{_CLASSES}, hits AS (SELECT c.entity, c.column_name, max(CASE WHEN detector = 'npi' AND lower(trim(c.entity)) IN ('provider', 'pharmacy') THEN 0.95 ELSE confidence END) AS best FROM cols c JOIN detectors ON regexp_matches(CASE WHEN column_name = 'provider_id' THEN 'npi' ELSE column_name END, pattern, 'i') GROUP BY c.entity, c.column_name) SELECT c.entity, c.column_name, coalesce(CAST(CAST(best AS DECIMAL(3, 2)) AS VARCHAR), '') AS resolved, n_values FROM cols c LEFT JOIN hits h ON h.entity = c.entity AND h.column_name = c.column_name")
def npi_entity_boost(spark, sf_dir):
    """Provider ids stand for NPIs here."""
    every = columns(spark, sf_dir)
    best = R.detect(every, F.when(F.col("column_name") == "provider_id", "npi").otherwise(F.col("column_name"))).groupBy(*R.KEYS).agg(F.max("confidence").alias("best"))
    return shown(every.join(best, R.KEYS, "left"), F.coalesce(F.col("best").cast("decimal(3,2)").cast("string"), F.lit("")))


@query("classify_columns", f"{_CLASSES} SELECT entity, column_name, category || ':' || CAST(CAST(confidence AS DECIMAL(3, 2)) AS VARCHAR) || ':' || layer AS resolved, n_values FROM classified")
def classify_columns(spark, sf_dir):
    return shown(classified(spark, sf_dir), F.concat_ws(":", "category", F.col("confidence").cast("decimal(3,2)").cast("string"), "layer"))


@query("tier_by_category", f"{_CLASSES} SELECT c.entity, c.column_name, t.tier AS resolved, n_values FROM classified c JOIN tiers t ON t.category = c.category")
def tier_by_category(spark, sf_dir):
    return shown(R.catalog(classified(spark, sf_dir).drop("tier"), frame(spark, OWNERS, ("source", "owner"))), F.col("tier"))


@query("build_catalog", f"{_CLASSES} SELECT c.entity, c.column_name, concat_ws('|', c.category, t.strategy, o.owner, CASE WHEN c.entity IN ('plan', 'diagnosis', 'procedure', 'pharmacy', 'provider', 'code') THEN 'persistent_reference' ELSE t.retention END) AS resolved, n_values FROM classified c JOIN tiers t ON t.category = c.category JOIN owners o ON o.source = c.source")
def build_catalog(spark, sf_dir):
    """The catalog of all columns, written and read back."""
    made = R.catalog(classified(spark, sf_dir).drop("tier"), frame(spark, OWNERS, ("source", "owner")))
    return shown(stash(made, "catalog"), F.concat_ws("|", "category", "strategy", "owner", "retention"))
