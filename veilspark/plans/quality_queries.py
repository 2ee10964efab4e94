"""Profiling, classification, gates and manifests over the estate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import hmac_sql
from ..operators import closure as C
from ..operators import gates as G
from ..operators import profile as D
from ..sources.shared import folder, stash
from .base import KEY, ORACLES, QUERIES, WITH, entity, names, query, table
from .masking_queries import MASKER, masked, numeric_sql, token_sql
from .metadata_queries import POLICY, RESOLVED, SOURCES, columns
from ..operators import rules
from .registry_queries import WITH as REGISTRY_WITH
from .registry_queries import load as registry
from .selection_queries import _COUNTS, _DANGLING, _EDGES, CLOSURE, LOGICAL, SELECTED_COUNTS, closed, dangling_references

_FLOATS = {"balance", "billed", "charge", "quantity", "result"}
KEYS = {"claim_line": "claim_id * 10 + line_number"}


def sort_key(e: str) -> str:
    return KEYS.get(e, names(e)[0])


def profile(spark, sf_dir, sources):
    parts = []
    for s in sources:
        for e in SOURCES[s]:
            df = entity(spark, sf_dir, e).withColumn("__key", F.expr(sort_key(e)))
            shown = [c for c in names(e) if c not in _FLOATS]
            found = D.counts(df, names(e)).join(D.samples(df, "__key", shown), "column_name", "left")
            parts.append(D.labelled(found.withColumn("samples", F.coalesce("samples", F.lit(""))), source=s, dataset=e))
    return D.union_all(parts)


def profile_sql(sources):
    parts = []
    for s in sources:
        for e in SOURCES[s]:
            head = f"(SELECT *, {sort_key(e)} AS key_ FROM {e} ORDER BY key_ LIMIT 200)"
            for c in names(e):
                shown = "''" if c in _FLOATS else f"coalesce((SELECT string_agg(v, '|' ORDER BY key_, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, key_ FROM {head} WHERE {c} IS NOT NULL ORDER BY key_, v LIMIT 5)), '')"
                parts.append(f"SELECT '{c}' AS column_name, CAST((SELECT count({c}) FROM {e}) AS BIGINT) AS n_values, {shown} AS samples, '{s}' AS source, '{e}' AS dataset")
    return f"{WITH} " + " UNION ALL ".join(parts)


for _key, _sources in {"profile_postgres_enrollment": ["enrollment"], "profile_claims_parquet": ["claims"], "profile_clinical_data_lake": ["clinical"], "profile_pbm_extract": ["pbm"], "profile_partner_lab_feed": ["partner"], "profile_estate": list(SOURCES)}.items():
    QUERIES[_key] = lambda spark, sf_dir, s=_sources: profile(spark, sf_dir, s)
    ORACLES[_key] = profile_sql(_sources)


@query("column_samples", f"{WITH} SELECT 'discharge_date' AS column_name, (SELECT string_agg(v, '|' ORDER BY encounter_id) FROM (SELECT discharge_date AS v, encounter_id FROM encounter WHERE discharge_date IS NOT NULL ORDER BY encounter_id LIMIT 5)) AS samples UNION ALL SELECT 'member_id', (SELECT string_agg(v, '|' ORDER BY encounter_id) FROM (SELECT CAST(member_id AS VARCHAR) AS v, encounter_id FROM encounter ORDER BY encounter_id LIMIT 5))")
def column_samples(spark, sf_dir):
    return D.samples(entity(spark, sf_dir, "encounter"), "encounter_id", ["discharge_date", "member_id"])


_TEXTS = {"conversations": ["role", "text"], "pages": ["url", "html"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"]}
_VALUE = [(d, p) for d, _, _, _, p in D.DETECTORS if p]


@query("pattern_detectors", " UNION ALL ".join(f"SELECT '{t}' AS dataset, '{c}' AS column_name, '{d}' AS detector, CAST(count({c}) AS BIGINT) AS n_values, CAST(count_if(regexp_matches({c}, '{p}')) AS BIGINT) AS n_hits FROM {t}" for t, cs in _TEXTS.items() for c in cs for d, p in _VALUE))
def pattern_detectors(spark, sf_dir):
    return D.union_all([D.labelled(D.value_hits(table(spark, sf_dir, t).select(*cs)), dataset=t) for t, cs in _TEXTS.items()])


# Validation of masked values

LINKED = [("member-id-global", "claim", "member_id"), ("member-id-global", "encounter", "member_id"), ("member-id-global", "prescription", "member_id"), ("provider-id-global", "claim", "provider_id"), ("provider-id-global", "claim_line", "provider_id")]
LINKS_SQL = "links AS (" + " UNION ALL ".join(f"SELECT '{s}' AS scope, CAST({c} AS VARCHAR) AS original, {token_sql(c, s)} AS masked FROM {e}" for s, e, c in LINKED) + ")"


def links(spark, sf_dir) -> DataFrame:
    token = lambda c, s: F.concat(F.lit("TKN-"), F.upper(F.substring(MASKER.digest(F.col(c), s), 1, 12)))
    return D.union_all([entity(spark, sf_dir, e).select(F.lit(s).alias("scope"), F.col(c).cast("string").alias("original"), token(c, s).alias("masked")) for s, e, c in LINKED])


@query("linkage_consistency", f"{WITH}, {LINKS_SQL} SELECT scope, CAST(count(*) AS BIGINT) AS n_originals, CAST(count_if(n > 1) AS BIGINT) AS n_inconsistent FROM (SELECT scope, original, count(DISTINCT masked) AS n FROM links GROUP BY scope, original) GROUP BY scope")
def linkage_consistency(spark, sf_dir):
    pairs = links(spark, sf_dir).groupBy("scope", "original").agg(F.countDistinct("masked").alias("n"))
    return pairs.groupBy("scope").agg(F.count("*").alias("n_originals"), F.count_if(F.col("n") > 1).alias("n_inconsistent"))


@query("collision_check", f"{WITH}, {LINKS_SQL} SELECT scope, CAST(count(*) AS BIGINT) AS n_masked, CAST(count_if(n > 1) AS BIGINT) AS n_collisions FROM (SELECT scope, masked, count(DISTINCT original) AS n FROM links GROUP BY scope, masked) GROUP BY scope")
def collision_check(spark, sf_dir):
    pairs = links(spark, sf_dir).groupBy("scope", "masked").agg(F.countDistinct("original").alias("n"))
    return pairs.groupBy("scope").agg(F.count("*").alias("n_masked"), F.count_if(F.col("n") > 1).alias("n_collisions"))


_LEAKY = "CASE WHEN c.c_custkey % 50 = 3 THEN 'masked for ' || c.c_name || CASE WHEN c.c_custkey % 2 = 0 THEN '!' ELSE '' END WHEN c.c_custkey % 50 = 4 THEN c.c_mktsegment ELSE 'masked ' || substr(md5(c.c_name), 1, 12) END"


@query("leak_check_theta_join", f"SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM (SELECT c_name AS raw FROM customer UNION SELECT s_name FROM supplier) r WHERE length(raw) >= 4 AND contains({_LEAKY}, raw))")
def leak_check_theta_join(spark, sf_dir):
    """All raw names of customers and suppliers against texts of which some hold one."""
    c = table(spark, sf_dir, "customer")
    texts = c.select("c_custkey", F.expr(_LEAKY.replace("c.", "")).alias("text"))
    return G.leaks(texts, "text", c.select("c_name").union(table(spark, sf_dir, "supplier").select("s_name")), "c_name").select("c_custkey")


_PROFILE = f"{WITH}, m AS (SELECT billed, {numeric_sql('billed', hmac_sql('claim_id', 'amount', KEY))} AS masked FROM claim) SELECT count(billed) AS source_n, CAST(sum(CAST(round(billed * 100) AS BIGINT)) AS BIGINT) / 100 / count(billed) AS source_mean, CAST(count_if(billed <> 0) AS BIGINT) AS source_nonzero, count(masked) AS masked_n, CAST(sum(CAST(round(masked * 100) AS BIGINT)) AS BIGINT) / 100 / count(masked) AS masked_mean, CAST(count_if(masked <> 0) AS BIGINT) AS masked_nonzero FROM m"


@query("mean_ratio_profile", _PROFILE)
def mean_ratio_profile(spark, sf_dir):
    from .masking_queries import synth_numeric

    source = D.numeric_profile(entity(spark, sf_dir, "claim"), "billed", "source")
    return source.join(F.broadcast(D.numeric_profile(synth_numeric(spark, sf_dir), "masked", "masked")))  # one row each


# Gates

_TALLY = f"tally AS (SELECT CAST(count_if(category = 'engine_bug') AS BIGINT) AS bugs, CAST(count_if(category = 'source_orphan') AS BIGINT) AS orphans FROM ({_DANGLING}))"


def tally(spark, sf_dir, both=None):
    return C.verdict(C.dangling(*both) if both else dangling_references(spark, sf_dir))


@query("gate_phi_pii_policy_coverage", f"{POLICY}, asked AS (SELECT * REPLACE (CASE WHEN column_name = 'line_number' THEN NULL ELSE tier END AS tier) FROM cols), {RESOLVED} SELECT 'phi_pii_policy_coverage' AS gate, count(*) = 0 AS passed, CAST(coalesce(sum(n_values), 0) AS VARCHAR) AS detail FROM resolved WHERE tier IS NULL OR tier <> 'non_sensitive' AND technique = 'passthrough'")
def gate_phi_pii_policy_coverage(spark, sf_dir, uncovered="line_number"):
    """Values of columns that no catalog entry covers, or that are protected and would pass through; the query leaves one column uncovered."""
    known = columns(spark, sf_dir).withColumn("tier", F.when(F.col("column_name") != uncovered, F.col("tier")))
    return G.policy_coverage(rules.resolve(known))


def gate_of_covered_columns(spark, sf_dir):
    return gate_phi_pii_policy_coverage(spark, sf_dir, "")


@query("gate_masking_completion", f"{WITH} SELECT 'masking_completion' AS gate, count(*) > 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM encounter")
def gate_masking_completion(spark, sf_dir):
    written = stash(masked(spark, sf_dir, "encounter"), "completion")
    sums = written.select("*", "_metadata.file_name").agg(F.count("*").alias("n"), F.countDistinct("file_name").alias("files"))
    return G.gate(sums, "masking_completion", (F.col("n") > 0) & (F.col("files") > 0), F.col("n"))


@query("gate_referential_integrity", f"{CLOSURE}, {_TALLY} SELECT 'referential_integrity' AS gate, bugs = 0 AS passed, CAST(bugs AS VARCHAR) AS detail FROM tally")
def gate_referential_integrity(spark, sf_dir, both=None):
    return G.gate(tally(spark, sf_dir, both), "referential_integrity", F.col("engine_bug") == 0, F.col("engine_bug"))


@query("gate_orphan_detection", f"{CLOSURE}, {_TALLY} SELECT 'orphan_detection' AS gate, orphans <= 5 AS passed, CAST(orphans AS VARCHAR) AS detail FROM tally")
def gate_orphan_detection(spark, sf_dir, both=None):
    return G.gate(tally(spark, sf_dir, both), "orphan_detection", F.col("source_orphan") <= 5, F.col("source_orphan"))


@query("gate_schema_validation", f"{CLOSURE} SELECT 'schema_validation' AS gate, true AS passed, CAST(0 * (SELECT count(*) FROM s_claim) AS VARCHAR) AS detail")
def gate_schema_validation(spark, sf_dir, both=None):
    """Row counts and columns of what is read back against what was written."""
    f, _ = both or closed(spark, sf_dir)
    read = {h.name: stash(f[h.name], f"subset-{h.name}") for h in C.HOPS}
    counts = lambda fs: D.union_all([fs[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("entity"), "n") for n in read])
    off = counts(f).withColumnRenamed("n", "expected").join(counts(read), "entity", "full").where("NOT (expected <=> n)").agg(F.count("*").alias("n"))
    same = all(read[n].columns == f[n].columns for n in read)
    return G.gate(off, "schema_validation", (F.col("n") == 0) & F.lit(same), F.col("n"))


@query("gate_data_quality_thresholds", f"{CLOSURE} SELECT 'data_quality_thresholds' AS gate, sum(n) >= 1 AND max(CASE WHEN entity = 'member' THEN n END) > 0 AS passed, CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) AS detail FROM ({SELECTED_COUNTS})")
def gate_data_quality_thresholds(spark, sf_dir, both=None):
    counts = C.row_counts((both or closed(spark, sf_dir))[0], LOGICAL)
    sums = counts.agg(F.sum("n").alias("n"), F.max(F.when(F.col("entity") == "member", F.col("n"))).alias("anchor"))
    return G.gate(sums, "data_quality_thresholds", (F.col("n") >= 1) & (F.coalesce("anchor", F.lit(0)) > 0), F.col("n"))


@query("gate_row_count_reconciliation", f"{CLOSURE} SELECT 'row_count_reconciliation' AS gate, count(*) = 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM ({SELECTED_COUNTS}) s JOIN ({_COUNTS}) f ON f.entity = s.entity WHERE f.n < s.n")
def gate_row_count_reconciliation(spark, sf_dir, both=None):
    f, e = both or closed(spark, sf_dir)
    selected = C.row_counts(f, LOGICAL).withColumnRenamed("n", "selected")
    short = selected.join(C.row_counts(e, LOGICAL), "entity").where("n < selected").agg(F.count("*").alias("n"))
    return G.gate(short, "row_count_reconciliation", F.col("n") == 0, F.col("n"))


@query("gate_distribution_shape", f"SELECT 'distribution_shape' AS gate, least(source_n, masked_n) < 5 OR masked_nonzero > 0 AND greatest(abs(source_mean), abs(masked_mean)) <= 10 * greatest(least(abs(source_mean), abs(masked_mean)), 1e-12) AS passed, CASE WHEN least(source_n, masked_n) < 5 THEN 'few values' ELSE 'compared' END AS detail FROM ({_PROFILE})")
def gate_distribution_shape(spark, sf_dir):
    return G.mean_ratio(mean_ratio_profile(spark, sf_dir))


_TYPES = ["signup", "view", "click", "purchase", "error", "refund"]


@query("gate_manifest_generation", f"WITH expected(manifest) AS (VALUES {', '.join(f'({t!r})' for t in _TYPES)}), missing AS (SELECT manifest FROM expected WHERE manifest NOT IN (SELECT event_type FROM events)) SELECT 'manifest_generation' AS gate, count(*) = 0 AS passed, coalesce(string_agg(manifest, ',' ORDER BY manifest), '') AS detail FROM missing")
def gate_manifest_generation(spark, sf_dir):
    """A manifest of counts is written for every kind of event that there is; those of expected kinds must be on disk."""
    root = folder(spark, "manifests")
    table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("manifest")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users")).write.partitionBy("manifest").json(root)
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").format("binaryFile").load(root).select(F.regexp_extract("path", r"/manifest=(\w+)/part-[^/]*$", 1).alias("manifest")).distinct()
    expected = spark.createDataFrame([(t,) for t in _TYPES], "manifest string")
    missing = expected.join(found, "manifest", "left_anti").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("manifest")), ",").alias("names"))
    return G.gate(missing, "manifest_generation", F.col("n") == 0, F.col("names"))


@query("gate_policy_version_recorded", f"{REGISTRY_WITH} SELECT 'policy_version_recorded' AS gate, count_if(policy_name = '' OR policy_version < 1) = 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM version")
def gate_policy_version_recorded(spark, sf_dir):
    sums = registry(spark, sf_dir, "version").agg(F.count("*").alias("n"), F.count_if((F.col("policy_name") == "") | (F.col("policy_version") < 1)).alias("bad"))
    return G.gate(sums, "policy_version_recorded", F.col("bad") == 0, F.col("n"))


@query("gate_masking_version_recorded", f"{REGISTRY_WITH} SELECT 'masking_version_recorded' AS gate, count_if(trim(report_id) = '') = 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM version")
def gate_masking_version_recorded(spark, sf_dir):
    sums = registry(spark, sf_dir, "version").agg(F.count("*").alias("n"), F.count_if(F.trim("report_id") == "").alias("blank"))
    return G.gate(sums, "masking_version_recorded", F.col("blank") == 0, F.col("n"))


# Manifests

_FP = "concat_ws('|', coalesce(CAST(claim_id AS VARCHAR), '~'), coalesce(CAST(member_id AS VARCHAR), '~'), coalesce(status, '~'))"


@query("table_fingerprint", f"{WITH}, h AS (SELECT CAST('0x' || substr(md5({_FP}), 1, 15) AS BIGINT) AS h FROM claim), s AS (SELECT count(*) AS n_rows, bit_xor(h) AS x, CAST(sum(h) AS HUGEINT) AS s FROM h), t AS (SELECT n_rows, CAST(n_rows AS VARCHAR) || ':' || CAST(x AS VARCHAR) || ':' || CAST(s AS VARCHAR) AS text FROM s) SELECT n_rows, {hmac_sql('text', 'fingerprint', KEY)} AS digest FROM t")
def table_fingerprint(spark, sf_dir):
    return G.fingerprint(entity(spark, sf_dir, "claim").select("claim_id", "member_id", "status"), KEY)


@query("subset_manifest", f"{CLOSURE}, {_TALLY} SELECT s.entity, f.n AS n_source, s.n AS n_selected, (SELECT orphans FROM tally) AS n_orphans FROM ({SELECTED_COUNTS}) s JOIN ({_COUNTS}) f ON f.entity = s.entity")
def subset_manifest(spark, sf_dir):
    """Counts before and after with the orphan count, one row for each entity of the manifest's maps."""
    f, e = closed(spark, sf_dir)
    counts = C.row_counts(f, LOGICAL).withColumnRenamed("n", "n_selected").join(C.row_counts(e, LOGICAL).withColumnRenamed("n", "n_source"), "entity")
    return counts.join(F.broadcast(C.verdict(C.dangling(f, e)).select(F.col("source_orphan").alias("n_orphans")))).select("entity", "n_source", "n_selected", "n_orphans")


@query("run_subsetting", f"{CLOSURE}, {_TALLY} SELECT e.child AS entity, e.n AS n_written, CASE WHEN bugs > 0 THEN 'failed' WHEN orphans > 0 THEN 'passed_with_known_orphans' ELSE 'passed' END AS verdict FROM ({_EDGES}) e, tally")
def run_subsetting(spark, sf_dir):
    """Select, close, validate, write every entity, and count what is read back."""
    f, e = closed(spark, sf_dir)
    verdict = C.verdict(C.dangling(f, e)).select("verdict")
    parts = [stash(f[h.name], f"subset-{h.name}").agg(F.count("*").alias("n_written")).select(F.lit(h.name).alias("entity"), "n_written") for h in C.HOPS]
    return D.union_all(parts).join(F.broadcast(verdict))
