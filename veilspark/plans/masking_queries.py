"""Masking techniques over the estate, with the same digests in DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import hmac_sql, number_sql
from ..operators import masking as M
from ..operators import policy as P
from ..sources.shared import folder, stash
from ..sources.vault import TokenVault
from .base import KEY, ORACLES, QUERIES, WITH, entity, query, table

MASKER = M.Masker(KEY, hidden=False)
SCOPE = "member-id-global"
H = hmac_sql("member_id", SCOPE, KEY)


def digests(spark, sf_dir, name="claim", column="member_id", scope=SCOPE):
    return entity(spark, sf_dir, name).withColumn("h", MASKER.digest(F.col(column), scope))


def entry_sql(names, start, h="h"):
    return f"[{', '.join(repr(n) for n in names)}][{number_sql(h, start, 8)} % {len(names)} + 1]"


def padded_sql(start, digits, h="h"):
    return f"lpad(CAST({number_sql(h, start, 12)} % {10**digits} AS VARCHAR), {digits}, '0')"


def shift_sql(value, h, most=365):
    text = f"substr(CAST({value} AS VARCHAR), 1, 10)"
    date = f"CASE WHEN regexp_matches({text}, '{M.ISO_DATE}') THEN TRY_CAST({text} AS DATE) END"
    return f"CASE WHEN {value} IS NOT NULL THEN coalesce(CAST(CAST({date} + CAST({number_sql(h, 1, 8)} % {2 * most + 1} - {most} AS INTEGER) AS DATE) AS VARCHAR), '{M.BAD_DATE}') END"


def numeric_sql(value, h):
    return f"floor(({number_sql(h, 1, 13)} % 1000000) / 1000000 * greatest(abs({value}) * 2, 100.0) * 100 + 0.5) / 100"


def shape_sql(value, h):
    text = f"CAST({value} AS VARCHAR)"
    n = f"({number_sql(h, '((i - 1) % 32) * 2 + 1', 2)} + (i - 1) // 32 * 7)"
    ch = f"substr({text}, i, 1)"
    return f"array_to_string(list_transform(range(1, length({text}) + 1), lambda i: CASE WHEN regexp_matches({ch}, '^[0-9]$') THEN chr(CAST({n} % 10 + 48 AS INTEGER)) WHEN regexp_matches({ch}, '^[A-Z]$') THEN chr(CAST({n} % 26 + 65 AS INTEGER)) WHEN regexp_matches({ch}, '^[a-z]$') THEN chr(CAST({n} % 26 + 97 AS INTEGER)) ELSE {ch} END), '')"


SYNTH_SQL = {
    "ssn": f"{padded_sql(1, 3)} || '-' || {padded_sql(13, 2)} || '-' || {padded_sql(25, 4)}",
    "email": f"lower({entry_sql(M.FIRST_NAMES, 1)}) || {padded_sql(17, 4)} || '@' || {entry_sql(M.DOMAINS, 33)}",
    "phone": f"'(' || {padded_sql(1, 3)} || ') ' || {padded_sql(13, 3)} || '-' || {padded_sql(25, 4)}",
    "first_name": entry_sql(M.FIRST_NAMES, 1),
    "last_name": entry_sql(M.LAST_NAMES, 9),
    "full_name": f"{entry_sql(M.FIRST_NAMES, 1)} || ' ' || {entry_sql(M.LAST_NAMES, 9)}",
    "street": f"CAST({number_sql('h', 17, 8)} % 9899 + 100 AS VARCHAR) || ' ' || {entry_sql(M.STREETS, 1)} || ' ' || {entry_sql(M.SUFFIXES, 9)}",
    "city": entry_sql(M.CITIES, 1),
    "zip": padded_sql(1, 5),
    "identifier": "'SYN-MASKED-' || upper(substr(h, 1, 8))",
}
_MAKE = {"ssn": M.ssn, "email": M.email, "phone": M.phone, "first_name": M.first_name, "last_name": M.last_name, "full_name": M.full_name, "street": M.street, "city": M.city, "zip": M.zip_code, "identifier": M.identifier}


def _register(name, value, sql):
    """A technique over the members of all claims: claim_id and the masked value."""

    def run(spark, sf_dir):
        return digests(spark, sf_dir).select("claim_id", value().alias("masked"))

    query(name, f"{WITH}, d AS (SELECT claim_id, member_id, {H} AS h FROM claim) SELECT claim_id, {sql} AS masked FROM d")(run)


for _name, _sql in SYNTH_SQL.items():
    _register(f"synth_{_name}", lambda make=_MAKE[_name]: make(F.col("h")), _sql)
_register("hmac_digest", lambda: F.col("h"), "h")
_register("hmac_pseudonymize", lambda: M.pseudonym(F.col("h")), "substr(h, 1, 32)")
_register("tokenize", lambda: M.token(F.col("h")), "'TKN-' || upper(substr(h, 1, 12))")
_register("hash_unkeyed", lambda: M.hash_unkeyed(F.col("member_id"), SCOPE), f"'HASH-' || substr(sha256('{SCOPE}:' || CAST(member_id AS VARCHAR)), 1, 16)")
_register("redact", lambda: M.redact(F.col("member_id"), keep_length=True), "repeat('*', length(CAST(member_id AS VARCHAR)))")
_register("nullify", lambda: M.nullify(F.col("member_id")), "CAST(NULL AS VARCHAR)")
_register("passthrough", lambda: F.col("member_id"), "member_id")


@query("synth_numeric", f"{WITH}, d AS (SELECT claim_id, billed, {hmac_sql('claim_id', 'amount', KEY)} AS h FROM claim) SELECT claim_id, {numeric_sql('billed', 'h')} AS masked FROM d")
def synth_numeric(spark, sf_dir):
    return digests(spark, sf_dir, column="claim_id", scope="amount").select("claim_id", M.numeric(F.col("billed"), F.col("h")).alias("masked"))


@query("format_preserving_chars", f"SELECT p_partkey, {shape_sql('p_name', hmac_sql('p_name', 'shape', KEY))} AS masked FROM part")
def format_preserving_chars(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.same_shape(F.col("p_name"), MASKER.digest(F.col("p_name"), "shape")).alias("masked"))


_SHIFT = shift_sql("discharge_date", hmac_sql("discharge_date", "dates", KEY))


@query("date_shift", f"{WITH} SELECT encounter_id, {_SHIFT} AS masked FROM encounter")
def date_shift(spark, sf_dir):
    return digests(spark, sf_dir, "encounter", "discharge_date", "dates").select("encounter_id", M.shift_date(F.col("discharge_date"), F.col("h")).alias("masked"))


@query("warning_quarantine", f"{WITH} SELECT 'masked' AS \"column\", CAST(count_if({_SHIFT} = '{M.BAD_DATE}') AS BIGINT) AS n FROM encounter")
def warning_quarantine(spark, sf_dir):
    return M.quarantine(date_shift(spark, sf_dir), ["masked"])


@query("mask_columns", f"{WITH} SELECT claim_id, substr({H}, 1, 32) AS member_id, substr({hmac_sql('provider_id', 'provider-id-global', KEY)}, 1, 32) AS provider_id, status FROM claim")
def mask_columns(spark, sf_dir):
    df = entity(spark, sf_dir, "claim").select("claim_id", "member_id", "provider_id", "status")
    return MASKER.columns(df, {"member_id": SCOPE, "provider_id": "provider-id-global", "absent": "any"})


@query("pandas_udf_mask", f"{WITH} SELECT claim_id, substr({H}, 1, 32) AS masked FROM claim")
def pandas_udf_mask(spark, sf_dir):
    """The same pseudonyms with the key hidden in an Arrow UDF."""
    return entity(spark, sf_dir, "claim").select("claim_id", M.pseudonym(M.Masker(KEY).digest(F.col("member_id"), SCOPE)).alias("masked"))


@query("filter_status", f"{WITH} SELECT claim_id, member_id FROM claim WHERE status = 'paid'")
def filter_status(spark, sf_dir):
    """The filter stays on the source column, so the scan gets it."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS claim_id", "o_custkey AS member_id")


@query("spark_claims_mask_job", f"{WITH} SELECT status, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT substr({H}, 1, 32)) AS BIGINT) AS n_members, min(substr({H}, 1, 32)) AS least FROM claim WHERE status = 'paid' GROUP BY status")
def spark_claims_mask_job(spark, sf_dir):
    """Filter, mask, write, and read the written table back for its counts."""
    masked = MASKER.columns(entity(spark, sf_dir, "claim").where("status = 'paid'"), {"member_id": SCOPE, "claim_id": "claim-id-global"})
    return stash(masked, "claims-masked").groupBy("status").agg(F.count("*").alias("n_rows"), F.countDistinct("member_id").alias("n_members"), F.min("member_id").alias("least"))


_VAULT_TOKEN = f"'TKN-' || upper(substr({hmac_sql('member_id', 'vault-0', KEY)}, 1, 12))"


@query("token_vault_table", f"{WITH} SELECT CAST(member_id AS VARCHAR) AS value, {_VAULT_TOKEN} AS token, member_id % 2 = 0 AS known_before FROM (SELECT DISTINCT member_id FROM claim)")
def token_vault_table(spark, sf_dir):
    """The vault after two runs: members of even number first, then all; what the first run gave stays."""
    vault = TokenVault(spark, folder(spark, "vault"), KEY, hidden=False, buckets=16)
    values = entity(spark, sf_dir, "claim").select(F.col("member_id").cast("string").alias("value"))
    vault.extend(values.where("CAST(value AS BIGINT) % 2 = 0"))
    first = vault.by_value.rows().select("value", F.col("token").alias("before"))
    vault.extend(values)
    kept = vault.by_value.rows().join(first, "value", "left")
    return kept.select("value", "token", F.coalesce(F.col("before") == F.col("token"), F.lit(False)).alias("known_before"))


#: Tiers of the columns that are masked here.
TIERS = {
    "member": {"member_id": "direct_identifier", "name": "direct_identifier", "gender": "quasi_identifier", "balance": "sensitive_clinical_attribute"},
    "claim": {"claim_id": "quasi_identifier", "member_id": "direct_identifier", "provider_id": "quasi_identifier", "status": "non_sensitive", "service_text": "quasi_identifier", "billed": "sensitive_clinical_attribute", "batch": "non_sensitive"},
    "claim_line": {"claim_id": "quasi_identifier", "line_number": "non_sensitive", "code": "non_sensitive", "provider_id": "quasi_identifier", "charge": "sensitive_clinical_attribute"},
    "encounter": {"encounter_id": "quasi_identifier", "member_id": "direct_identifier", "provider_id": "quasi_identifier", "discharge_date": "quasi_identifier"},
    "lab_ehr": {"lab_id": "non_sensitive", "member_id": "direct_identifier", "result": "non_sensitive"},
    "prescription": {"rx_id": "non_sensitive", "member_id": "direct_identifier", "quantity": "sensitive_clinical_attribute"},
    "lab_partner_v1": {"lab_id": "non_sensitive", "pat_id": "direct_identifier", "result": "non_sensitive"},
    "lab_partner_v2": {"lab_id": "non_sensitive", "member_id": "direct_identifier", "result": "non_sensitive"},
    "coverage": {"coverage_id": "quasi_identifier", "member_id": "direct_identifier", "plan_id": "non_sensitive", "status": "non_sensitive"},
    "provider": {"provider_id": "quasi_identifier", "provider_name": "sensitive_clinical_attribute", "nation": "non_sensitive"},
    "member_demographics": {"member_id": "direct_identifier", "segment": "non_sensitive", "nation": "non_sensitive"},
    "address": {"address_id": "quasi_identifier", "member_id": "direct_identifier", "zip": "quasi_identifier"},
    "plan": {"plan_id": "non_sensitive", "plan_name": "non_sensitive", "region_id": "non_sensitive"},
    "pharmacy": {"pharmacy_id": "non_sensitive", "pharmacy_name": "sensitive_clinical_attribute"},
    "code": {"code": "non_sensitive", "description": "non_sensitive", "kind": "non_sensitive"},
}


def token_sql(column, scope):
    return f"'TKN-' || upper(substr({hmac_sql(column, scope, KEY)}, 1, 12))"


def masked(spark, sf_dir, name):
    return MASKER.table(entity(spark, sf_dir, name).select(*TIERS[name]), TIERS[name])


@query("mask_table", f"{WITH} SELECT {token_sql('encounter_id', 'encounter-id-global')} AS encounter_id, {token_sql('member_id', SCOPE)} AS member_id, {token_sql('provider_id', 'provider-id-global')} AS provider_id, {shift_sql('discharge_date', hmac_sql('discharge_date', 'quasi-identifier-default', KEY))} AS discharge_date FROM encounter")
def mask_table(spark, sf_dir):
    return masked(spark, sf_dir, "encounter")


#: The column that names an entity's rows, in SQL as it is masked.
ID_OF = {n: next((c for c in t if P.linkage_scope(c) == SCOPE), next(iter(t))) for n, t in TIERS.items()}


def id_sql(name):
    c = ID_OF[name]
    return token_sql(c, P.linkage_scope(c)) if P.linkage_scope(c) and TIERS[name][c] != "non_sensitive" else f"CAST({c} AS VARCHAR)"


def ids_sql(names):
    return " UNION ALL ".join(f"SELECT '{n}' AS entity, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT {ID_OF[n]}) AS BIGINT) AS n_tokens, min({id_sql(n)}) AS least FROM {n}" for n in names)


def ids(name, df):
    """Rows, distinct masked ids and the least one of a masked entity; ids are grouped by hash, and nothing is sorted."""
    each = df.groupBy(F.col(ID_OF[name]).cast("string").alias("c")).agg(F.count("*").alias("k"))
    return each.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"), F.count("c").alias("n_tokens"), F.min("c").alias("least")).select(F.lit(name).alias("entity"), "n_rows", "n_tokens", "least")


@query("mask_estate", f"{WITH} {ids_sql(TIERS)}")
def mask_estate(spark, sf_dir):
    """Every entity masked, written and read back."""
    frames = {n: entity(spark, sf_dir, n).select(*t) for n, t in TIERS.items()}
    return reduce(DataFrame.unionByName, [ids(n, stash(df, f"masked-{n}")) for n, df in MASKER.estate(frames, TIERS).items()])
