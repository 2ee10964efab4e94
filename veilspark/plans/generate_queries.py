"""Generation over seed rows of the given tables, tagging and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import pick, pick_order_sql
from ..operators import generate as G
from .base import ORACLES, QUERIES, SEED, WITH, entity, query, table

#: Generator -> (table, key, filter): its seed rows.
SEEDS = {name: ("customer", "c_custkey", f"c_custkey % 40 = {k}") for k, name in enumerate(G.SCENARIOS)}
ALL = G.SCENARIOS


def seeds(spark, sf_dir, name):
    source, key, where = SEEDS[name]
    return table(spark, sf_dir, source).where(where).select(F.col(key).cast("long").alias("i"))


def seeds_sql(name):
    source, key, where = SEEDS[name]
    return f"SELECT CAST({key} AS BIGINT) AS i FROM {source} WHERE {where}"


def rows(spark, sf_dir, name):
    return ALL[name].rows(seeds(spark, sf_dir, name), SEED)


def rows_sql(name):
    return ALL[name].sql(seeds_sql(name), SEED)


for _name in ALL:
    QUERIES[_name] = lambda spark, sf_dir, n=_name: rows(spark, sf_dir, n)
    ORACLES[_name] = rows_sql(_name)

_U = lambda tag: G.render(f"{{u:{tag}}}", G.DUCKDB, SEED)
_SEEDED = "SELECT CAST(o_orderkey AS BIGINT) AS i, o_orderkey AS claim_id, o_totalprice AS billed, CASE o_orderstatus WHEN 'F' THEN 'denied' ELSE 'paid' END AS status, CAST(1 + o_orderkey % 4 AS INT) AS n_lines FROM orders"


@query("claim_with_lines", f"SELECT claim_id, line_number, allowed, CASE WHEN status <> 'denied' THEN floor((allowed * (0.6 + 0.4 * {_U('paid')})) * 100 + 0.5) / 100 END AS paid, floor((billed / n_lines) * 100 + 0.5) / 100 AS charge FROM (SELECT *, unnest(range(1, n_lines + 1)) AS line_number, floor((billed * (0.5 + 0.4 * {_U('allowed')})) * 100 + 0.5) / 100 AS allowed FROM ({_SEEDED}))")
def claim_with_lines(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS BIGINT) AS i", "o_orderkey AS claim_id", "o_totalprice AS billed", "CASE o_orderstatus WHEN 'F' THEN 'denied' ELSE 'paid' END AS status", "CAST(1 + o_orderkey % 4 AS INT) AS n_lines")
    return G.claim_with_lines(claims, SEED).select("claim_id", "line_number", "allowed", "paid", "charge")


@query("reference_pool", f"{WITH}, pool AS (SELECT provider_id, row_number() OVER (ORDER BY provider_id) - 1 AS place FROM provider) SELECT c.claim_id, p.provider_id FROM claim c JOIN pool p ON p.place = CAST('0x' || substr(md5(CAST(c.claim_id AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT count(*) FROM pool)")
def reference_pool(spark, sf_dir):
    """Each claim linked to a provider of the estate by its hash: ids and their number in one row of bounded size.

    The pool is numbered through range partitions' counts, and joined by number.
    """
    pool = entity(spark, sf_dir, "provider").select("provider_id")
    from pyspark.sql.window import Window

    # an even cut of the ids: numbers inside a cut, and the counts of the cuts before it
    cut = pool.withColumn("cut", F.floor(F.col("provider_id") / 1000))
    own = cut.withColumn("own", F.row_number().over(Window.partitionBy("cut").orderBy("provider_id")))
    sizes = cut.groupBy("cut").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = own.join(before, "cut").select("provider_id", (F.col("own") + F.col("before") - 1).alias("place"))
    n = numbered.agg(F.count("*").alias("n_pool"))
    claims = entity(spark, sf_dir, "claim").select("claim_id").join(F.broadcast(n))  # one row
    place = F.conv(F.substring(F.md5(F.col("claim_id").cast("string")), 1, 8), 16, 10).cast("long") % F.col("n_pool")
    return claims.withColumn("place", place).join(numbered, "place").select("claim_id", "provider_id")


@query("edge_case_rates", f"{WITH} SELECT member_id FROM member ORDER BY {pick_order_sql('edge', 'member_id')}, member_id LIMIT (SELECT greatest(1, round_even(count(*) * 0.03, 0)) FROM member)::BIGINT")
def edge_case_rates(spark, sf_dir):
    """Exactly max(1, round(n * rate)) rows, by hash rank."""
    members = entity(spark, sf_dir, "member").select("member_id")
    return pick(members, "member_id", max(1, round(members.count() * 0.03)), "edge")


_SCEN = "'SYN-{p}-SCEN-' || lpad(CAST({i} AS VARCHAR(20)), CAST(greatest(6, length(CAST({i} AS VARCHAR(20)))) AS INT), '0')"


@query("scenario_ids", f"SELECT c_custkey, {_SCEN.format(p='CLM', i='c_custkey + 1')} AS claim_id, {_SCEN.format(p='CLM', i='c_custkey + 1').replace('SCEN-', 'SCEN-NX-COV-')} AS dangling_id FROM customer")
def scenario_ids(spark, sf_dir):
    i = F.col("c_custkey") + 1
    return table(spark, sf_dir, "customer").select("c_custkey", F.format_string("SYN-%s-SCEN-%06d", F.lit("CLM"), i).alias("claim_id"), F.format_string("SYN-%s-SCEN-NX-%s-%06d", F.lit("CLM"), F.lit("COV"), i).alias("dangling_id"))


# Tags and merging

_NORMAL = rows_sql("scenario_normal_claims")


@query("tag_rows", f"SELECT claim_id, 'synthetic' AS data_provenance, 'batch-1' AS synthetic_batch_id, 'normal_claims' AS scenario_type FROM ({_NORMAL})")
def tag_rows(spark, sf_dir):
    return G.tag(rows(spark, sf_dir, "scenario_normal_claims"), "synthetic", "batch-1", "normal_claims").select("claim_id", "data_provenance", "synthetic_batch_id", "scenario_type")


@query("tag_base_estate", f"{WITH} SELECT claim_id, CASE WHEN claim_id % 10 = 0 THEN 'synthetic' ELSE 'masked_production_like' END AS data_provenance, CASE WHEN claim_id % 10 = 0 THEN 'old' ELSE 'batch-1' END AS synthetic_batch_id FROM claim")
def tag_base_estate(spark, sf_dir):
    tagged = F.col("claim_id") % 10 == 0
    df = entity(spark, sf_dir, "claim").select("claim_id", F.when(tagged, "synthetic").alias("data_provenance"), F.when(tagged, "old").alias("synthetic_batch_id"))
    return G.tag_base(df, "batch-1")


_MERGED = f"SELECT CAST(claim_id AS VARCHAR) AS claim_id, batch, 'masked_production_like' AS data_provenance, NULL AS coverage_id FROM claim UNION ALL SELECT claim_id, 'synthetic-scenarios', 'synthetic', coverage_id FROM ({_NORMAL})"


def merged(spark, sf_dir):
    base = G.tag_base(entity(spark, sf_dir, "claim").select(F.col("claim_id").cast("string").alias("claim_id"), "batch"), "batch-1")
    new = G.tag(rows(spark, sf_dir, "scenario_normal_claims").select("claim_id", "coverage_id"), "synthetic", "batch-1", "normal_claims")
    return G.merge(base, new, "synthetic-scenarios")


@query("merge_scenarios", f"{WITH} {_MERGED}")
def merge_scenarios(spark, sf_dir):
    return merged(spark, sf_dir).select("claim_id", "batch", "data_provenance", "coverage_id")


@query("provenance_counts", f"{WITH} SELECT data_provenance, count(*) AS n FROM ({_MERGED}) GROUP BY data_provenance")
def provenance_counts(spark, sf_dir):
    return G.provenance_counts([merged(spark, sf_dir)])


@query("gate_provenance", f"{WITH} SELECT 'provenance' AS gate, true AS passed, CAST(count(*) AS VARCHAR) AS detail FROM ({_MERGED})")
def gate_provenance(spark, sf_dir):
    from ..operators.gates import gate

    sums = merged(spark, sf_dir).agg(F.count("*").alias("n"), F.count("data_provenance").alias("tagged"))
    return gate(sums, "provenance", F.col("n") == F.col("tagged"), F.col("n"))


_SCENARIO_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS scenario, count(*) AS n_rows FROM ({rows_sql(n)})" for n in G.SCENARIOS)


@query("generate_scenarios", _SCENARIO_COUNTS)
def generate_scenarios(spark, sf_dir):
    """All eleven scenarios, tagged, written and read back."""
    from functools import reduce

    from ..sources.shared import stash

    parts = [stash(G.tag(rows(spark, sf_dir, n), "synthetic", "batch-1", n), n).groupBy(F.col("scenario_type").alias("scenario")).agg(F.count("*").alias("n_rows")) for n in G.SCENARIOS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("synthetic_manifest", f"{WITH} SELECT scenario, n_rows, CAST((SELECT sum(n_rows) FROM ({_SCENARIO_COUNTS})) AS BIGINT) AS n_total, (SELECT count(*) FROM claim) AS n_base FROM ({_SCENARIO_COUNTS})")
def synthetic_manifest(spark, sf_dir):
    from ..sources.shared import stash

    records = stash(generate_scenarios(spark, sf_dir), "scenario-records")
    totals = records.agg(F.sum("n_rows").alias("n_total")).join(F.broadcast(entity(spark, sf_dir, "claim").agg(F.count("*").alias("n_base"))))
    return records.join(F.broadcast(totals))  # totals are one row


# Projections of rows

@query("normalize_rows", f"{WITH} SELECT lab_id, pat_id, NULL AS member_id, result FROM lab_partner_v1 UNION ALL SELECT lab_id, NULL, member_id, result FROM lab_partner_v2")
def normalize_rows(spark, sf_dir):
    return G.merge(entity(spark, sf_dir, "lab_partner_v1"), entity(spark, sf_dir, "lab_partner_v2")).select("lab_id", "pat_id", "member_id", "result")


QUERIES["drift_concat"] = lambda spark, sf_dir: normalize_rows(spark, sf_dir).agg(F.count("*").alias("n"), F.count("pat_id").alias("n_v1"), F.count("member_id").alias("n_v2"))
ORACLES["drift_concat"] = f"{WITH} SELECT (SELECT count(*) FROM lab_partner_v1) + (SELECT count(*) FROM lab_partner_v2) AS n, (SELECT count(pat_id) FROM lab_partner_v1) AS n_v1, (SELECT count(member_id) FROM lab_partner_v2) AS n_v2"


@query("nan_to_null", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS l_tax FROM lineitem")
def nan_to_null(spark, sf_dir):
    """NaN of float columns becomes null."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"))
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in floats})


@query("claim_schema_projection", f"{WITH} SELECT claim_id, CASE WHEN batch = '2024Q4' THEN billed END AS paid_amount, CASE WHEN batch = '2025Q1' THEN billed END AS amount_paid, billed AS paid FROM claim")
def claim_schema_projection(spark, sf_dir):
    """Legacy and current column sets, and their unification."""
    c = entity(spark, sf_dir, "claim")
    legacy = c.where("batch = '2024Q4'").select("claim_id", F.col("billed").alias("paid_amount"))
    current = c.where("batch = '2025Q1'").select("claim_id", F.col("billed").alias("amount_paid"))
    return legacy.unionByName(current, allowMissingColumns=True).withColumn("paid", F.coalesce("paid_amount", "amount_paid"))


@query("late_arrival_flag", f"{WITH} SELECT encounter_id, coalesce(DATE '2024-04-15' - TRY_CAST(discharge_date AS DATE) > 90, false) AS late FROM encounter")
def late_arrival_flag(spark, sf_dir):
    return entity(spark, sf_dir, "encounter").select("encounter_id", late(F.lit("2024-04-15").cast("date"), "discharge_date").alias("late"))


def late(delivered, collected):
    """More than 90 days from collection to delivery; a date that does not parse is not late."""
    return F.coalesce(F.datediff(delivered, F.try_to_date(collected, "yyyy-MM-dd")) > 90, F.lit(False))


@query("batch_by_year", "SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1998 THEN '2024Q4' ELSE '2025Q1' END AS batch FROM orders")
def batch_by_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.year("o_orderdate") <= 1998, "2024Q4").otherwise("2025Q1").alias("batch"))
