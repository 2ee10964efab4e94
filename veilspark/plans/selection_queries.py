"""Selection, closure and their aggregates over the estate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import hmac_sql, pick_order, pick_order_sql
from ..operators import closure as C
from ..operators import masking as M
from ..operators import selection as S
from ..sources.shared import stash
from .base import ESTATE, KEY, ORACLES, QUERIES, SEED, WITH, entity, estate, query

ORDER = pick_order_sql(SEED, "member_id")
ANCHOR = f"anchor AS (SELECT member_id FROM (SELECT member_id, row_number() OVER (ORDER BY {ORDER}, member_id) AS place FROM member) WHERE place <= (SELECT greatest(1, round_even(count(*) * 2 / 100.0, 0)) FROM member))"
#: Columns of an entity that name its rows.
NAMES = {"member": ["member_id"], "member_demographics": ["member_id"], "address": ["address_id", "member_id"], "coverage": ["coverage_id", "member_id", "plan_id"], "plan": ["plan_id", "plan_name"], "claim": ["claim_id", "member_id", "batch"], "claim_line": ["claim_id", "line_number"], "code": ["code", "description"], "prescription": ["rx_id", "member_id"], "pharmacy": ["pharmacy_id"], "encounter": ["encounter_id", "member_id"], "lab_ehr": ["lab_id", "member_id"], "lab_partner_v1": ["lab_id", "pat_id"], "lab_partner_v2": ["lab_id", "member_id"], "provider": ["provider_id", "provider_name"]}
CLOSED = [f"s_{h.name} AS (SELECT * FROM {h.entity} WHERE {h.key} IN ({' UNION ALL '.join(f'SELECT {c} FROM {s if s == "anchor" else "s_" + s} WHERE {c} IS NOT NULL' for s, c in h.sources)}))" for h in C.HOPS]
CLOSURE = f"{WITH}, {ANCHOR}, " + ", ".join(CLOSED)
HOP_OF = {h.entity: h.name for h in C.HOPS}


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.percentage_sample(entity(spark, sf_dir, "member"), "member_id", 2, SEED)


def closed(spark: SparkSession, sf_dir: str, only: str | None = None) -> tuple[dict, dict]:
    e = estate(spark, sf_dir)
    if only:
        return C.closure(e, anchors(spark, sf_dir), only), e
    return C.closure(e, stash(anchors(spark, sf_dir), "anchors"), write=lambda df, name: stash(df, f"closed-{name}")), e


def _register_hop(hop: C.Hop) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return closed(spark, sf_dir, hop.name)[0][hop.name].select(*NAMES[hop.entity])

    query(f"closure_{hop.name}", f"{CLOSURE} SELECT {', '.join(NAMES[hop.entity])} FROM s_{hop.name}")(run)


for _hop in C.HOPS:
    _register_hop(_hop)


@query("closure_lab_partner", f"{CLOSURE} SELECT lab_id, member_id, 'v2' AS shape FROM s_lab_partner_v2 UNION ALL SELECT lab_id, pat_id, 'v1' FROM s_lab_partner_v1")
def closure_lab_partner(spark, sf_dir):
    f, _ = closed(spark, sf_dir, "lab_partner_v2")
    return f["lab_partner_v2"].select("lab_id", "member_id", F.lit("v2").alias("shape")).unionByName(f["lab_partner_v1"].select("lab_id", F.col("pat_id").alias("member_id"), F.lit("v1").alias("shape")))


_EDGES = " UNION ALL ".join(f"SELECT '{h.sources[0][0]}' AS parent, '{h.name}' AS child, count(*) AS n FROM s_{h.name}" for h in C.HOPS)


@query("closure_full", f"{CLOSURE} {_EDGES}")
def closure_full(spark, sf_dir):
    return C.edges(closed(spark, sf_dir)[0])


QUERIES["relationship_edges"], ORACLES["relationship_edges"] = closure_full, f"{CLOSURE} SELECT * FROM ({_EDGES}) WHERE parent <> 'anchor'"
QUERIES["relationship_edges"] = lambda spark, sf_dir: closure_full(spark, sf_dir).where("parent <> 'anchor'")

_DANGLING = " UNION ALL ".join(
    f"SELECT '{name}' AS relationship, id, CASE WHEN id IN (SELECT {pk} FROM {parent}) THEN 'engine_bug' ELSE 'source_orphan' END AS category FROM (SELECT DISTINCT {fk} AS id FROM s_{HOP_OF[child]}) WHERE id NOT IN (SELECT {pk} FROM s_{HOP_OF[parent]})" for name, (child, fk, parent, pk) in C.RELATIONSHIPS.items()
)


@query("dangling_references", f"{CLOSURE} {_DANGLING}")
def dangling_references(spark, sf_dir):
    return C.dangling(*closed(spark, sf_dir))


@query("dangling_tally", f"{CLOSURE} SELECT relationship, CAST(sum(CASE category WHEN 'engine_bug' THEN 1 ELSE 0 END) AS BIGINT) AS engine_bug, CAST(sum(CASE category WHEN 'source_orphan' THEN 1 ELSE 0 END) AS BIGINT) AS source_orphan FROM ({_DANGLING}) GROUP BY relationship")
def dangling_tally(spark, sf_dir):
    return C.dangling_tally(dangling_references(spark, sf_dir))


@query("subset_validation", f"{CLOSURE} SELECT CAST(count_if(category = 'engine_bug') AS BIGINT) AS engine_bug, CAST(count_if(category = 'source_orphan') AS BIGINT) AS source_orphan, CAST(0 AS BIGINT) AS negative_test, CASE WHEN count_if(category = 'engine_bug') > 0 THEN 'failed' WHEN count(*) > 0 THEN 'passed_with_known_orphans' ELSE 'passed' END AS verdict FROM ({_DANGLING})")
def subset_validation(spark, sf_dir):
    return C.verdict(dangling_references(spark, sf_dir))


@query("negative_test_injection", f"{CLOSURE}, gone AS (SELECT DISTINCT provider_id FROM s_provider WHERE provider_id IN (SELECT provider_id FROM s_claim) ORDER BY provider_id LIMIT 2) SELECT 'claim.provider_id' AS relationship, claim_id AS id, 'negative_test' AS category FROM s_claim WHERE provider_id IN (SELECT provider_id FROM gone)")
def negative_test_injection(spark, sf_dir):
    return C.inject_orphans(closed(spark, sf_dir)[0], 2)[1]


LOGICAL = {"member": ["member"], "coverage": ["coverage"], "plan": ["plan"], "claim": ["claim"], "claim_line": ["claim_line"], "provider": ["provider"], "prescription": ["prescription"], "encounter": ["encounter"], "lab_result": ["lab_ehr", "lab_partner_v1", "lab_partner_v2"]}
_COUNTS = " UNION ALL ".join(f"SELECT '{k}' AS entity, CAST(count(*) AS BIGINT) AS n FROM ({' UNION ALL '.join(f'SELECT 1 FROM {x}' for x in v)})" for k, v in LOGICAL.items())
SELECTED_COUNTS = " UNION ALL ".join(f"SELECT '{k}' AS entity, CAST(count(*) AS BIGINT) AS n FROM ({' UNION ALL '.join(f'SELECT 1 FROM s_{HOP_OF[x]}' for x in v)})" for k, v in LOGICAL.items())


@query("entity_row_counts", f"{WITH} {_COUNTS}")
def entity_row_counts(spark, sf_dir):
    return C.row_counts(estate(spark, sf_dir), LOGICAL)


@query("distinct_values", f"{WITH} SELECT DISTINCT CAST(provider_id AS VARCHAR) AS value FROM claim WHERE provider_id IS NOT NULL")
def distinct_values(spark, sf_dir):
    return C.distinct_values(entity(spark, sf_dir, "claim"), "provider_id")


QUERIES["str_coerce"] = lambda spark, sf_dir: entity(spark, sf_dir, "claim").select("claim_id", F.col("member_id").cast("string").alias("member_id"))
ORACLES["str_coerce"] = f"{WITH} SELECT claim_id, CAST(member_id AS VARCHAR) AS member_id FROM claim"


@query("filter_key_in_set", f"{WITH} SELECT claim_id, member_id FROM claim WHERE CAST(member_id AS VARCHAR) IN (SELECT CAST(member_id AS VARCHAR) FROM encounter)")
def filter_key_in_set(spark, sf_dir):
    keys = C.distinct_values(entity(spark, sf_dir, "encounter"), "member_id")
    claims = entity(spark, sf_dir, "claim")
    return claims.join(keys, claims.member_id.cast("string") == keys.value, "left_semi").select("claim_id", "member_id")


@query("percentage_sample", f"{WITH}, {ANCHOR} SELECT member_id FROM anchor")
def percentage_sample(spark, sf_dir):
    return anchors(spark, sf_dir)


@query("fixed_population", f"{WITH} SELECT member_id FROM member ORDER BY {ORDER}, member_id LIMIT 250")
def fixed_population(spark, sf_dir):
    return S.fixed_population(entity(spark, sf_dir, "member"), "member_id", 250, SEED)


_BERNOULLI = f"CAST('0x' || substr({pick_order_sql('sample', 'member_id')}, 1, 8) AS BIGINT) < 85899345"


@query("member_sample_distinct", f"{WITH} SELECT DISTINCT member_id FROM claim WHERE {_BERNOULLI}")
def member_sample_distinct(spark, sf_dir):
    """Distinct members of claims, each kept with chance 0.02 by its hash."""
    return entity(spark, sf_dir, "claim").select("member_id").distinct().where(F.conv(F.substring(pick_order("sample", "member_id"), 1, 8), 16, 10).cast("long") < 85899345)


@query("subset_broadcast_join", f"{WITH} SELECT claim_id, member_id, status FROM claim WHERE {_BERNOULLI}")
def subset_broadcast_join(spark, sf_dir):
    """Claims of the sampled members: a semi join that is broadcast only where Spark measures the ids small."""
    return entity(spark, sf_dir, "claim").join(member_sample_distinct(spark, sf_dir), "member_id", "left_semi").select("claim_id", "member_id", "status")


@query("subset_second_hop_join", f"{WITH} SELECT claim_id, line_number, code FROM claim_line WHERE claim_id IN (SELECT claim_id FROM claim WHERE {_BERNOULLI})")
def subset_second_hop_join(spark, sf_dir):
    ids = subset_broadcast_join(spark, sf_dir).select("claim_id").distinct()
    return entity(spark, sf_dir, "claim_line").join(ids, "claim_id", "left_semi").select("claim_id", "line_number", "code")


@query("selectivity", f"{WITH} SELECT CAST(count(*) AS BIGINT) AS n_in, CAST(count_if({_BERNOULLI}) AS BIGINT) AS n_out, CASE WHEN count(*) = 0 THEN 0.0 ELSE count_if({_BERNOULLI}) / count(*) END AS selectivity FROM claim")
def selectivity(spark, sf_dir):
    kept = subset_broadcast_join(spark, sf_dir).agg(F.count("*").alias("n_out"))
    both = entity(spark, sf_dir, "claim").agg(F.count("*").alias("n_in")).join(F.broadcast(kept))  # one row each
    return both.withColumn("selectivity", F.when(F.col("n_in") == 0, 0.0).otherwise(F.col("n_out") / F.col("n_in")))


_STRATA = "strata AS (SELECT m.member_id, coalesce(CASE WHEN m.member_id % 7 = 0 THEN NULL ELSE m.gender END, d.segment, 'None') AS stratum FROM member m LEFT JOIN member_demographics d ON d.member_id = m.member_id)"


def _strata(spark, sf_dir):
    members = entity(spark, sf_dir, "member").withColumn("gender", F.when(F.col("member_id") % 7 == 0, None).otherwise(F.col("gender")))
    return S.strata(members, entity(spark, sf_dir, "member_demographics"), "member_id", "gender", "segment")


@query("stratum_lookup_join", f"{WITH}, {_STRATA} SELECT member_id, stratum FROM strata")
def stratum_lookup_join(spark, sf_dir):
    return _strata(spark, sf_dir)


_PICKED = f"picked AS (SELECT member_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {ORDER}, member_id) AS place FROM strata) WHERE place <= 20)"


@query("stratified_sample", f"{WITH}, {_STRATA}, {_PICKED} SELECT member_id, stratum FROM picked")
def stratified_sample(spark, sf_dir):
    return S.stratified_sample(_strata(spark, sf_dir), "member_id", 20, SEED)


@query("strata_counts", f"{WITH}, {_STRATA}, {_PICKED} SELECT stratum, count(*) AS members, CAST(count_if(member_id IN (SELECT member_id FROM picked)) AS BIGINT) AS selected FROM strata GROUP BY stratum")
def strata_counts(spark, sf_dir):
    all_ = _strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("members"))
    return all_.withColumn("selected", F.least("members", F.lit(20).cast("long")))


@query("iso_prefix_between", f"{WITH} SELECT DISTINCT member_id FROM claim WHERE substr(service_text, 1, 10) BETWEEN '1996-01-01' AND '1996-02-15'")
def iso_prefix_between(spark, sf_dir):
    return S.date_window(entity(spark, sf_dir, "claim"), "member_id", "service_text", "1996-01-01", "1996-02-15")


_RULE = "SELECT member_id FROM claim WHERE status = 'paid' GROUP BY member_id HAVING count(*) >= 4"


@query("claims_per_member_having", f"{WITH} SELECT member_id, count(*) AS n_claims FROM claim WHERE status = 'paid' GROUP BY member_id HAVING count(*) >= 4")
def claims_per_member_having(spark, sf_dir):
    return S.claims_per_member(entity(spark, sf_dir, "claim"), "member_id", "paid", 4)


@query("business_rule_join", f"{WITH} {_RULE} INTERSECT SELECT member_id FROM coverage WHERE status = 'active'")
def business_rule_join(spark, sf_dir):
    return S.business_rule(entity(spark, sf_dir, "coverage"), entity(spark, sf_dir, "claim"), "member_id", least=4)


@query("id_intersection", f"{WITH} SELECT DISTINCT member_id FROM coverage WHERE status = 'active' INTERSECT SELECT member_id FROM encounter")
def id_intersection(spark, sf_dir):
    return entity(spark, sf_dir, "coverage").where("status = 'active'").select("member_id").intersect(entity(spark, sf_dir, "encounter").select("member_id"))


@query("id_difference", f"{WITH} SELECT DISTINCT provider_id FROM claim WHERE provider_id NOT IN (SELECT provider_id FROM provider)")
def id_difference(spark, sf_dir):
    return entity(spark, sf_dir, "claim").select("provider_id").distinct().join(entity(spark, sf_dir, "provider"), "provider_id", "left_anti")


@query("provider_id_union", f"{WITH} SELECT provider_id FROM claim UNION SELECT provider_id FROM encounter UNION SELECT prescriber_id FROM prescription")
def provider_id_union(spark, sf_dir):
    return C.key_union(estate(spark, sf_dir), (("claim", "provider_id"), ("encounter", "provider_id"), ("prescription", "prescriber_id")), "provider_id")


@query("no_coverage_anti_join", f"{WITH} SELECT member_id FROM member WHERE member_id NOT IN (SELECT member_id FROM coverage)")
def no_coverage_anti_join(spark, sf_dir):
    return S.without(entity(spark, sf_dir, "member"), entity(spark, sf_dir, "coverage"), "member_id")


@query("line_to_member_join", f"{WITH} SELECT DISTINCT member_id FROM claim WHERE claim_id IN (SELECT claim_id FROM claim_line WHERE code % 997 = 5)")
def line_to_member_join(spark, sf_dir):
    return S.members_of_lines(entity(spark, sf_dir, "claim_line"), entity(spark, sf_dir, "claim"), F.col("code") % 997 == 5)


_SIGNALS = f"""signals AS (SELECT DISTINCT signal, member_id FROM (
SELECT 'negative_amount' AS signal, member_id FROM claim WHERE billed < 0
UNION ALL SELECT 'unmapped_code', member_id FROM claim WHERE claim_id IN (SELECT claim_id FROM claim_line WHERE code % 997 = 5)
UNION ALL SELECT 'orphan_provider', member_id FROM claim WHERE provider_id >= 112
UNION ALL SELECT 'malformed_discharge', member_id FROM encounter WHERE discharge_date IN ('TBD', 'UNKNOWN', '')
UNION ALL SELECT 'malformed_zip', member_id FROM address WHERE zip IN ('00000', 'ABCDE', '')
UNION ALL SELECT 'negative_quantity', member_id FROM prescription WHERE quantity < 0
UNION ALL SELECT 'no_coverage', member_id FROM member WHERE member_id NOT IN (SELECT member_id FROM coverage)
UNION ALL SELECT 'terminated', member_id FROM coverage WHERE status = 'terminated') WHERE member_id IN (SELECT member_id FROM member))"""


def _signals(spark, sf_dir):
    return S.risk_signals(estate(spark, sf_dir), F.col("code") % 997 == 5, F.col("provider_id") >= 112)


@query("risk_edge_case_union", f"{WITH}, {_SIGNALS} SELECT signal, count(*) AS n_members FROM signals GROUP BY signal")
def risk_edge_case_union(spark, sf_dir):
    return _signals(spark, sf_dir).groupBy("signal").agg(F.count("*").alias("n_members"))


@query("risk_cap", f"{WITH}, {_SIGNALS} SELECT member_id FROM (SELECT DISTINCT member_id FROM signals) ORDER BY {ORDER}, member_id LIMIT 100")
def risk_cap(spark, sf_dir):
    return S.fixed_population(_signals(spark, sf_dir).select("member_id").distinct(), "member_id", 100, SEED)


@query("predicate_malformed", f"{WITH} SELECT 'discharge_date' AS field, CAST(count(*) AS BIGINT) AS n FROM encounter WHERE discharge_date IN ('TBD', 'UNKNOWN', '') UNION ALL SELECT 'zip', count(*) FROM address WHERE zip IN ('00000', 'ABCDE', '') UNION ALL SELECT 'billed', count(*) FROM claim WHERE billed < 0 UNION ALL SELECT 'quantity', count(*) FROM prescription WHERE quantity < 0")
def predicate_malformed(spark, sf_dir):
    e = estate(spark, sf_dir)
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("field"), "n")
    return one("discharge_date", e["encounter"].where(S.malformed_discharge())).unionByName(one("zip", e["address"].where(S.malformed_zip()))).unionByName(one("billed", e["claim"].where("billed < 0"))).unionByName(one("quantity", e["prescription"].where("quantity < 0")))


assert set(NAMES) == set(ESTATE)


@query("flagship", f"""{WITH}, {ANCHOR}, c AS (SELECT claim_id, member_id FROM claim WHERE member_id IN (SELECT member_id FROM anchor)), l AS (SELECT claim_id, count(*) AS n FROM claim_line GROUP BY claim_id)
SELECT m.gender AS segment, count(DISTINCT m.member_id) AS n_members, count(c.claim_id) AS n_claims, CAST(coalesce(sum(l.n), 0) AS BIGINT) AS n_lines, min('TKN-' || upper(substr({hmac_sql('m.member_id', 'member-id-global', KEY)}, 1, 12))) AS sample_member
FROM member m LEFT JOIN c ON c.member_id = m.member_id LEFT JOIN l ON l.claim_id = c.claim_id WHERE m.member_id IN (SELECT member_id FROM anchor) GROUP BY m.gender""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed 2 % subset of members, claims and lines with masked members, by market segment.

    Lines and claims are counted before they meet members, so no join multiplies rows.
    """
    f, _ = closed(spark, sf_dir, "claim_line")
    lines = f["claim_line"].groupBy("claim_id").agg(F.count("*").alias("n"))
    claims = f["claim"].select("claim_id", "member_id").join(lines, "claim_id", "left").groupBy("member_id").agg(F.count("*").alias("claims"), F.sum("n").alias("lines"))
    members = f["member"].select("member_id", F.col("gender").alias("segment"), M.token(M.Masker(KEY, hidden=False).digest(F.col("member_id"), "member-id-global")).alias("token"))
    zero = F.lit(0).cast("long")
    return members.join(claims, "member_id", "left").groupBy("segment").agg(F.count("*").alias("n_members"), F.coalesce(F.sum("claims"), zero).alias("n_claims"), F.coalesce(F.sum("lines"), zero).alias("n_lines"), F.min("token").alias("sample_member"))
