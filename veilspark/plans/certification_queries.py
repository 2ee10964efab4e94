"""Whole certification runs over the estate, and SQL that classifies, closes and masks it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import hmac_sql
from ..operators import certification as X
from ..operators import gates as G
from ..operators import masking as M
from ..sources.shared import folder
from .base import ESTATE, KEY, WITH, entity, names, query
from .masking_queries import MASKER, entry_sql, numeric_sql, padded_sql, shape_sql, shift_sql
from .metadata_queries import _DETECTORS_SQL, _RULES_SQL, ALL_COLS, OVERRIDES, OWNERS, RESOLVED, RULES, SOURCE_OF, frame
from .selection_queries import _DANGLING, ANCHOR, CLOSED, HOP_OF, anchors

NUMBERS = {"balance", "billed", "charge", "quantity", "result"}
SECRETS = (("member", "name"), ("provider", "provider_name"), ("pharmacy", "pharmacy_name"))


def scenario(spark, sf_dir) -> dict[str, DataFrame]:
    """One normal claim for each plan, tagged as synthetic, in the masked shape."""
    plans = entity(spark, sf_dir, "plan")
    tags = {"data_provenance": F.lit("synthetic"), "synthetic_batch_id": F.lit("scenarios"), "scenario_type": F.lit("normal_claims")}
    claims = plans.select(F.concat(F.lit("SYN-CLM-"), "plan_id").alias("claim_id"), F.concat(F.lit("SYN-MBR-"), "plan_id").alias("member_id"), F.lit("paid").alias("status"), F.lit(50.0).alias("billed"))
    return {"claim": claims.withColumns(tags)}


def certified(spark, sf_dir, terms: X.Terms, root: str | None = None, frames=None, scenarios=None):
    """A run over all entities of the estate."""
    frames = frames or {e: entity(spark, sf_dir, e) for e in ESTATE}
    names = ("entity", "column_name", "category")
    return X.certify(root or folder(spark, "certification"), frames, SOURCE_OF, anchors(spark, sf_dir), MASKER, frame(spark, RULES, names), frame(spark, OVERRIDES, names), frame(spark, OWNERS, ("source", "owner")), terms, scenarios)


def text(c: str, kind: str) -> Column:
    """A cell as text that both engines write alike."""
    return F.round(F.col(c) * 100).cast("long").cast("string") if kind == "double" else F.col(c).cast("string")


def digests(frames: dict[str, DataFrame]) -> DataFrame:
    """entity and a digest of all cells of all rows, whatever their order."""
    parts = []
    for name, df in frames.items():
        row = F.concat_ws("|", *(F.coalesce(text(c, t), F.lit("~")) for c, t in sorted(df.dtypes) if c not in X.TAGS))
        parts.append(df.agg(F.coalesce(F.bit_xor(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")), F.lit(0)).alias("digest")).select(F.lit(name).alias("entity"), "digest"))
    return X.union(parts)


# The same run in SQL: columns are classified, rules follow from the classes, and every cell is masked by its column's rule.


def cell_sql(c: str) -> str:
    """The masked cell: t_, k_ and h_ of a column are its technique, its field type and the cell's digest."""
    h, raw = f"h_{c}", f"CAST({c} AS VARCHAR)"
    number = f"CAST(CAST(round(({numeric_sql(c, h)}) * 100) AS BIGINT) AS VARCHAR)" if c in NUMBERS else "NULL"
    plain = f"CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)" if c in NUMBERS else raw
    name = f"{entry_sql(M.FIRST_NAMES, 1, h)} || ' ' || {entry_sql(M.LAST_NAMES, 9, h)}"
    made = f"CASE k_{c} WHEN 'numeric' THEN {number} WHEN 'full_name' THEN {name} WHEN 'identifier' THEN 'SYN-MASKED-' || upper(substr({h}, 1, 8)) WHEN 'zip_code' THEN {padded_sql(1, 5, h)} ELSE {shape_sql(c, h)} END"
    return f"CASE t_{c} WHEN 'passthrough' THEN {plain} WHEN 'tokenization' THEN 'TKN-' || upper(substr({h}, 1, 12)) WHEN 'hmac_pseudonymization' THEN substr({h}, 1, 32) WHEN 'date_shift' THEN {shift_sql(c, h)} ELSE CASE WHEN {c} IS NOT NULL THEN {made} END END"


def entity_sql(e: str) -> str:
    """m_ of an entity: its raw cells, their rules, and the masked cells as m_ of each column."""
    known = ", ".join(f"max({v}) FILTER (column_name = '{c}') AS {k}_{c}" for c in names(e) for k, v in (("t", "technique"), ("s", "scope"), ("k", "kind")))
    digests = ", ".join(f"{hmac_sql(c, f"' || s_{c} || '", KEY)} AS h_{c}" for c in names(e))
    return f"m_{e} AS MATERIALIZED (SELECT *, {', '.join(f'{cell_sql(c)} AS m_{c}' for c in names(e))} FROM (SELECT *, {digests} FROM s_{HOP_OF[e]}, (SELECT {known} FROM ruled_columns WHERE entity = '{e}')))"


#: Columns in classes, with tiers, techniques, scopes and field types.
CLASSED = f"""{ALL_COLS}, {_RULES_SQL}, {_DETECTORS_SQL},
asked AS (SELECT c.entity, c.column_name, c.n_rows, c.n_values, t.tier FROM classified c JOIN tiers t ON t.category = c.category), {RESOLVED},
ruled_columns AS MATERIALIZED (SELECT v.*, coalesce(k.kind, 'generic') AS kind FROM resolved v LEFT JOIN (SELECT entity, column_name, arg_min(kind, number) AS kind FROM asked JOIN kinds ON regexp_matches(column_name, pattern, 'i') GROUP BY entity, column_name) k ON k.entity = v.entity AND k.column_name = v.column_name)"""
BASE = f"{WITH}, {ANCHOR}, {', '.join(CLOSED)}, {CLASSED}"
MASKED = f"{BASE}, {', '.join(entity_sql(e) for e in ESTATE)}"
_LINE = {e: " || '|' || ".join(f"coalesce(m_{c}, '~')" for c in sorted(names(e))) for e in ESTATE}
_ROWS = " UNION ALL ".join(f"SELECT '{e}' AS entity, (SELECT count(*) FROM {e}) AS n_source, (SELECT count(*) FROM s_{HOP_OF[e]}) AS n_selected, count(*) AS n_masked, coalesce(bit_xor(CAST('0x' || substr(md5({line}), 1, 15) AS BIGINT)), 0) AS digest FROM m_{e}" for e, line in _LINE.items())
_LINKED = " UNION ALL ".join(f"SELECT s_{c} AS scope, CAST({c} AS VARCHAR) AS original, m_{c} AS masked FROM m_{e} WHERE t_{c} = 'tokenization' AND {c} IS NOT NULL" for e in ESTATE for c in names(e))
_SHOWN = " UNION ALL ".join(f"SELECT m_{c} AS shown FROM m_{e}" for e in ESTATE for c in names(e) if c not in NUMBERS)
_RAW = " UNION ".join(f"SELECT {c} AS raw FROM s_{HOP_OF[e]} WHERE length({c}) >= 4" for e, c in SECRETS)
_BILLED = "SELECT billed, CAST(m_billed AS BIGINT) / 100 AS masked FROM m_claim"


def gates_sql(added: str, most: str) -> str:
    """The laws of the twelve gates; ``added`` counts scenario rows, ``most`` the orphans allowed."""
    laws = {
        "phi_pii_policy_coverage": "(SELECT count(*) FROM ruled_columns WHERE tier IS NULL OR tier <> 'non_sensitive' AND technique = 'passthrough') = 0",
        "masking_completion": "(SELECT sum(n_masked) FROM masked_rows) > 0 AND (SELECT count(*) FROM (SELECT 1 FROM linked GROUP BY scope, original HAVING count(DISTINCT masked) > 1)) + (SELECT count(*) FROM (SELECT 1 FROM linked GROUP BY scope, masked HAVING count(DISTINCT original) > 1)) + (SELECT count(*) FROM shown WHERE EXISTS (SELECT 1 FROM raws WHERE contains(shown, raw))) = 0",
        "referential_integrity": "(SELECT count(*) FROM dangling WHERE category = 'engine_bug') = 0",
        "schema_validation": "(SELECT count(*) FROM masked_rows WHERE n_masked <> n_selected) = 0",
        "data_quality_thresholds": f"(SELECT sum(n_masked) + {added} FROM masked_rows) >= 1 AND (SELECT n_masked FROM masked_rows WHERE entity = 'member') > 0",
        "row_count_reconciliation": "(SELECT count(*) FROM masked_rows WHERE n_masked < n_selected) = 0",
        "orphan_detection": f"(SELECT count(*) FROM dangling WHERE category = 'source_orphan') <= {most}",
        "provenance": f"(SELECT sum(n_selected) FROM masked_rows) + {added} = (SELECT sum(n_masked) FROM masked_rows) + {added}",
        "manifest_generation": "(SELECT count(*) FROM masked_rows) = (SELECT count(DISTINCT entity) FROM cols)",
        "policy_version_recorded": "(SELECT count(*) FROM (VALUES ('default', 1)) v(name, version) WHERE name = '' OR version < 1) = 0",
        "masking_version_recorded": "(SELECT count(*) FROM (VALUES ('1')) v(version) WHERE trim(version) = '') = 0",
        "distribution_shape": f"(SELECT count(*) < 5 OR count_if(masked <> 0) > 0 AND greatest(abs(avg(billed)), abs(avg(masked))) <= 10 * greatest(least(abs(avg(billed)), abs(avg(masked))), 1e-12) FROM ({_BILLED}))",
    }
    return "gates AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{k}' AS gate, {law} AS passed" for k, law in laws.items()) + ")"


_ADDED = "(SELECT count(*) FROM plan)"
_JUDGED = f"{MASKED}, masked_rows AS MATERIALIZED ({_ROWS}), linked AS MATERIALIZED ({_LINKED}), shown AS MATERIALIZED (SELECT DISTINCT shown FROM ({_SHOWN})), raws AS MATERIALIZED ({_RAW}), dangling AS MATERIALIZED ({_DANGLING})"


@query("certification_pipeline", f"{_JUDGED}, {gates_sql(_ADDED, '1000000000')} SELECT 'gate' AS part, gate AS name, passed, CAST(NULL AS BIGINT) AS n_source, CAST(NULL AS BIGINT) AS n_selected, CAST(NULL AS BIGINT) AS n_final, CAST(NULL AS BIGINT) AS digest, (SELECT CASE WHEN bool_and(passed) THEN 'certified' ELSE 'failed' END FROM gates) AS status FROM gates UNION ALL SELECT 'entity', entity, (SELECT bool_and(passed) FROM gates), n_source, n_selected, n_masked + CASE WHEN entity = 'claim' THEN {_ADDED} ELSE 0 END, digest, (SELECT CASE WHEN bool_and(passed) THEN 'certified' ELSE 'failed' END FROM gates) FROM masked_rows")
def certification_pipeline(spark, sf_dir):
    """Profile, classify, select and close, mask by the catalog of the run, add scenarios, twelve gates, publish.

    A row a gate, and a row an entity with its rows at source, selected and final, a
    digest of all its masked cells as readers see them, and whether they see them.
    """
    root = folder(spark, "certification")
    run, gates, status = certified(spark, sf_dir, X.Terms(secrets=SECRETS), root, scenarios=scenario(spark, sf_dir))
    seen = X.published(spark, root) or {}
    found = digests({n: df.where("scenario_type IS NULL") for n, df in (seen or run.final).items()}).withColumnRenamed("entity", "name")
    out = X.report(run, gates, status).join(found, "name", "left")
    return out.select("part", "name", F.when(F.col("part") == "gate", F.col("passed")).otherwise(F.lit(bool(seen))).alias("passed"), "n_source", "n_selected", "n_final", "digest", "status")


@query("certify_verdict", f"{_JUDGED}, {gates_sql('0', '5')} SELECT count(*) AS n_gates, CAST(count_if(passed) AS BIGINT) AS n_passed, CASE WHEN bool_and(passed) THEN 'certified' ELSE 'failed' END AS status FROM gates")
def certify_verdict(spark, sf_dir):
    """All twelve gates over one run without scenarios, with at most five orphans."""
    _, gates, _ = certified(spark, sf_dir, X.Terms(most_orphans=5, secrets=SECRETS))
    return G.certify(gates)


@query("masking_validation_report", f"{_JUDGED}, found AS (SELECT 'consistency' AS check_name, (SELECT count(*) FROM (SELECT 1 FROM linked GROUP BY scope, original HAVING count(DISTINCT masked) > 1)) AS n_findings UNION ALL SELECT 'collisions', (SELECT count(*) FROM (SELECT 1 FROM linked GROUP BY scope, masked HAVING count(DISTINCT original) > 1)) UNION ALL SELECT 'foreign', (SELECT count(*) FROM linked WHERE masked IS NULL OR masked = original) UNION ALL SELECT 'leaks', (SELECT count(*) FROM shown WHERE EXISTS (SELECT 1 FROM raws WHERE contains(shown, raw)))) SELECT check_name, n_findings, n_findings = 0 AS passed FROM found")
def masking_validation_report(spark, sf_dir):
    """The checks of one masking run over all entities: every raw name against every masked text cell, linked ids both ways."""
    run, _, _ = certified(spark, sf_dir, X.Terms(secrets=SECRETS))
    return run.read(spark, "validation").select("check_name", "n_findings", (F.col("n_findings") == 0).alias("passed"))


_WARNED = {e: " + ".join(f"CASE WHEN t_{c} = 'date_shift' AND m_{c} = '{M.BAD_DATE}' THEN 1 ELSE 0 END" for c in names(e)) for e in ESTATE}
_RECORDS = " UNION ALL ".join(f"SELECT '{e}' AS entity, count(*) AS n_rows, CAST({len(names(e))} AS INT) AS n_columns, CAST(coalesce(sum({w}), 0) AS BIGINT) AS n_warnings FROM m_{e}" for e, w in _WARNED.items())


@query("masking_summary", f"{_JUDGED}, records AS ({_RECORDS}), used AS (SELECT entity, technique, count(*) AS k FROM ruled_columns GROUP BY entity, technique) SELECT r.*, (SELECT string_agg(technique || ':' || CAST(k * n_rows AS VARCHAR), ',' ORDER BY technique) FROM used u WHERE u.entity = r.entity) AS techniques, 'default' AS policy_name, CAST(1 AS INT) AS policy_version, '1' AS engine_version, (SELECT count(*) FROM (SELECT 1 FROM linked GROUP BY scope, masked HAVING count(DISTINCT original) > 1)) = 0 AS validation_passed FROM records r")
def masking_summary(spark, sf_dir):
    """The record of a masking run over all entities, counted while the tables were written."""
    run, _, _ = certified(spark, sf_dir, X.Terms(secrets=SECRETS))
    used = F.array_join(F.transform(F.array_sort(F.map_entries("techniques")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return run.read(spark, "manifests/masking").select("entity", "n_rows", "n_columns", "n_warnings", used.alias("techniques"), "policy_name", "policy_version", "engine_version", "validation_passed")
