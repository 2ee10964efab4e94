"""Registry jobs over snapshots that the given tables stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as R
from ..sources.shared import folder
from ..sources.snapshots import SnapshotTable
from .base import query, table

AS_OF = "2024-01-20"
_ENV = "CASE {0} % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'qa' WHEN 2 THEN 'sit' WHEN 3 THEN 'uat' ELSE 'performance' END"
_CADENCE = "CASE {0} % 5 WHEN 0 THEN 'weekly' WHEN 1 THEN 'biweekly' WHEN 2 THEN 'monthly' WHEN 3 THEN 'release_driven' ELSE 'on_demand' END"
_DS = "'ds-' || CAST({0} % {1} AS VARCHAR(10))"
_COUNTS = "'{{\"member\":' || CAST({0} % 100 AS VARCHAR(10)) || ',\"claim\":' || CAST({0} % 1000 AS VARCHAR(10)) || '}}'"
REGISTRY: dict[str, tuple[str, list[str], str | None]] = {
    "version": ("orders", ["o_orderkey AS version_id", "o_orderkey + 1 AS version_number", f"{_DS.format('o_custkey', 50)} AS dataset_name", "CASE o_orderkey % 10 WHEN 6 THEN 'expired' WHEN 7 THEN 'revoked' WHEN 8 THEN 'rolled_back' ELSE 'active' END AS status", "CAST(o_orderdate AS DATE) AS created_at", "CAST(o_orderdate AS DATE) + 9000 - CAST(o_orderkey % 9000 AS INT) AS expires_at", "CAST(floor(o_totalprice) AS BIGINT) AS size_bytes", "'report-' || CAST(o_orderkey AS VARCHAR(20)) AS report_id", f"{_COUNTS.format('o_orderkey')} AS row_counts_json", "o_orderkey % 100 + o_orderkey % 1000 AS total_rows", "'policy-' || CAST(o_orderkey % 7 AS VARCHAR(10)) AS policy_name", "o_orderkey % 50 + 1 AS policy_version"], None),
    "request": ("customer", ["c_custkey AS request_id", f"{_ENV.format('c_nationkey')} AS environment", f"{_DS.format('c_custkey', 53)} AS dataset_name", "(c_custkey - c_custkey % 3) * 10 + (c_custkey - c_custkey % 3) % 9 AS version_id", "CASE c_custkey % 8 WHEN 1 THEN 'paused' WHEN 2 THEN 'retired' ELSE 'active' END AS status", f"{_CADENCE.format('c_custkey')} AS cadence", "CASE WHEN c_custkey % 6 = 0 THEN 10 END AS interval_days", "CASE WHEN c_custkey % 5 < 3 THEN DATE '2024-01-01' + CAST(c_custkey % 60 AS INT) END AS next_refresh_at"], None),
    "policy": ("nation", [f"{_ENV.format('n_nationkey')} AS environment", "CASE WHEN n_nationkey >= 5 THEN 'ds-' || CAST(n_nationkey AS VARCHAR(10)) END AS dataset_name", f"{_CADENCE.format('n_regionkey')} AS cadence", "CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 3 END AS interval_days"], None),
    "policy_version": ("part", ["p_partkey AS policy_version_id", "'policy-' || CAST(p_partkey % 7 AS VARCHAR(10)) AS policy_name", "p_size AS version", "CASE p_partkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'draft' WHEN 2 THEN 'superseded' ELSE 'rejected' END AS status"], None),
    "audit": ("events", ["event_id", "event_type", f"{_DS.format('user_id', 50)} AS subject", "'u' || CAST(user_id % 13 AS VARCHAR(10)) AS actor", "ts AS occurred_at"], None),
    "command": ("events", ["user_id AS request_id", "event_id AS target"], "event_type = 'error'"),
    "revocation": ("events", ["event_id * 2 AS version_id", "CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 'audit finding' END AS reason"], "event_type = 'click'"),
    "report": ("events", ["'report-' || CAST(event_id * 3 AS VARCHAR(20)) AS report_id", f"{_DS.format('user_id', 60)} AS dataset_name", "ts AS created_at"], "event_type = 'signup'"),
    "consumer_request": ("events", ["event_id AS consumer_request_id", f"{_ENV.format('user_id')} AS environment", f"{_DS.format('event_id', 60)} AS dataset_name", "event_id % 3000 AS policy_version_id", f"{_CADENCE.format('event_id')} AS cadence"], "event_type = 'purchase'"),
    "history": ("events", ["user_id AS id", "event_id", "ts AS occurred_at", "CASE event_type WHEN 'signup' THEN 'draft' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'certified' WHEN 'purchase' THEN 'published' ELSE 'revoked' END AS status"], None),
    "catalog": ("part", ["p_brand AS source_system", "p_type AS dataset", "p_name || '-' || CAST(p_partkey AS VARCHAR(20)) AS column_name", "CASE p_partkey % 6 WHEN 0 THEN 'direct_identifier' WHEN 1 THEN 'quasi_identifier' WHEN 2 THEN 'phi' WHEN 3 THEN 'pii' WHEN 4 THEN 'sensitive' ELSE 'non_sensitive' END AS category", "(p_partkey * 7 % 100) / 100.0 AS confidence", "CASE WHEN p_partkey % 9 = 0 THEN 'steward' END AS confirmed_by", "'detector-' || CAST(p_size % 15 AS VARCHAR(10)) AS detector", "'owner-' || p_brand AS owner"], None),
}
#: Category -> place, most severe first.
PLACE = "CASE category WHEN 'direct_identifier' THEN 0 WHEN 'quasi_identifier' THEN 1 WHEN 'phi' THEN 2 WHEN 'pii' THEN 3 WHEN 'sensitive' THEN 4 ELSE 5 END"


def load(spark, sf_dir, name):
    source, columns, where = REGISTRY[name]
    df = table(spark, sf_dir, source)
    return (df.where(where) if where else df).selectExpr(*columns)


WITH = "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(c)} FROM {s}{f' WHERE {w}' if w else ''})" for n, (s, c, w) in REGISTRY.items())
LATEST = "latest AS (SELECT dataset_name, max(version_number) - 1 AS version_id, max(version_number) AS version_number FROM version WHERE status = 'active' GROUP BY dataset_name)"
DAYS = "CASE {c} WHEN 'weekly' THEN coalesce({i}, 7) WHEN 'biweekly' THEN coalesce({i}, 14) WHEN 'monthly' THEN coalesce({i}, 30) END"
RESOLVED = "resolved AS (SELECT r.*, coalesce(o.cadence, d.cadence) AS policy_cadence, CASE WHEN o.cadence IS NOT NULL THEN o.interval_days ELSE d.interval_days END AS policy_interval FROM request r LEFT JOIN policy o ON o.environment = r.environment AND o.dataset_name = r.dataset_name LEFT JOIN policy d ON d.environment = r.environment AND d.dataset_name IS NULL)"


def snapshots(spark, sf_dir, name, key, **more) -> SnapshotTable:
    """A registry table as the first snapshot of a table of its own."""
    return SnapshotTable.create(spark, folder(spark, f"registry-{name}"), load(spark, sf_dir, name).withColumns(more), key, buckets=16)


_EXPIRED = f"CASE WHEN status = 'active' AND expires_at <= DATE '{AS_OF}' THEN 'expired' ELSE status END"


@query("retention_expiry", f"{WITH} SELECT version_id, dataset_name, {_EXPIRED} AS status FROM version")
def retention_expiry(spark, sf_dir):
    """The next snapshot of all versions, as it is read back."""
    versions = snapshots(spark, sf_dir, "version", "version_id")
    R.expire_job(versions, AS_OF)
    return versions.rows().select("version_id", "dataset_name", "status")


@query("due_refreshes", f"{WITH} SELECT request_id, environment, dataset_name FROM request WHERE status = 'active' AND next_refresh_at <= DATE '{AS_OF}'")
def due_refreshes(spark, sf_dir):
    return R.due_refreshes(load(spark, sf_dir, "request"), AS_OF).select("request_id", "environment", "dataset_name")


@query("latest_active_version", f"{WITH}, {LATEST} SELECT * FROM latest")
def latest_active_version(spark, sf_dir):
    return R.latest_active(load(spark, sf_dir, "version"))


@query("policy_resolution_join", f"{WITH}, {RESOLVED} SELECT request_id, policy_cadence, policy_interval FROM resolved")
def policy_resolution_join(spark, sf_dir):
    return R.resolve_policies(load(spark, sf_dir, "request"), load(spark, sf_dir, "policy")).select("request_id", "policy_cadence", "policy_interval")


@query("cadence_next_refresh", f"{WITH} SELECT request_id, DATE '{AS_OF}' + {DAYS.format(c='cadence', i='interval_days')} AS next_refresh_at FROM request")
def cadence_next_refresh(spark, sf_dir):
    return load(spark, sf_dir, "request").select("request_id", R.next_refresh(F.col("cadence"), F.col("interval_days"), F.lit(AS_OF).cast("date")).alias("next_refresh_at"))


_PLAN = f"plan AS (SELECT request_id, r.dataset_name, l.version_id AS to_version, CASE WHEN l.version_id IS NULL THEN 'failed' ELSE 'success' END AS outcome, CASE WHEN l.version_id IS NULL THEN 'no ACTIVE version' END AS error, CASE WHEN l.version_id IS NOT NULL THEN DATE '{AS_OF}' + {DAYS.format(c='policy_cadence', i='policy_interval')} END AS due FROM resolved r LEFT JOIN latest l ON l.dataset_name = r.dataset_name WHERE status = 'active' AND next_refresh_at <= DATE '{AS_OF}')"


@query("bulk_refresh_plan", f"{WITH}, {LATEST}, {RESOLVED}, {_PLAN} SELECT r.request_id, r.dataset_name, CASE WHEN p.outcome = 'success' THEN p.to_version ELSE r.version_id END AS version_id, CASE WHEN p.outcome = 'success' THEN p.due ELSE r.next_refresh_at END AS next_refresh_at, p.outcome, p.error FROM request r LEFT JOIN plan p ON p.request_id = r.request_id")
def bulk_refresh_plan(spark, sf_dir):
    """The next snapshot of all requests, with the outcome of those that were due."""
    requests = snapshots(spark, sf_dir, "request", "request_id")
    versions, policies = load(spark, sf_dir, "version"), load(spark, sf_dir, "policy")
    plan = R.bulk_refresh(requests.rows(), versions, policies, AS_OF).select("request_id", "outcome", "error")
    R.refresh_job(requests, versions, policies, AS_OF)
    return requests.rows().join(plan, "request_id", "left").select("request_id", "dataset_name", "version_id", "next_refresh_at", "outcome", "error")


_FIRST = "first_command AS (SELECT request_id, min(target) AS target FROM command GROUP BY request_id)"


def rolled_sql(version: str) -> str:
    """valid: the commands that hold against a table of versions; rolled: the versions that they change."""
    return f"""valid AS (SELECT c.request_id, c.target, r.version_id AS was FROM first_command c JOIN request r ON r.request_id = c.request_id JOIN {version} v ON v.version_id = c.target WHERE v.status <> 'revoked' AND c.target <> r.version_id),
moved AS (SELECT coalesce(v.target, r.version_id) AS version_id FROM request r LEFT JOIN valid v ON v.request_id = r.request_id),
rolled AS (SELECT version_id, 'rolled_back' AS new_status FROM {version} WHERE status = 'active' AND version_id IN (SELECT was FROM valid) AND version_id NOT IN (SELECT version_id FROM moved)
UNION ALL SELECT version_id, 'active' FROM {version} WHERE status = 'rolled_back' AND version_id IN (SELECT target FROM valid))"""


def first_commands(spark, sf_dir):
    return load(spark, sf_dir, "command").groupBy("request_id").agg(F.min("target").alias("target"))


@query("rollback_plan", f"{WITH}, {_FIRST}, {rolled_sql('version')} SELECT v.version_id, v.status AS old_status, coalesce(r.new_status, v.status) AS new_status FROM version v LEFT JOIN rolled r ON r.version_id = v.version_id")
def rollback_plan(spark, sf_dir):
    """All versions in the snapshot before the commands and in the one after."""
    versions, requests = snapshots(spark, sf_dir, "version", "version_id"), snapshots(spark, sf_dir, "request", "request_id")
    R.rollback_job(versions, requests, first_commands(spark, sf_dir))
    return versions.rows(1).select("version_id", F.col("status").alias("old_status")).join(versions.rows().select("version_id", F.col("status").alias("new_status")), "version_id")


@query("request_dedup", f"{WITH} SELECT environment, dataset_name, min(consumer_request_id) AS consumer_request_id FROM consumer_request c WHERE NOT EXISTS (SELECT 1 FROM request r WHERE r.environment = c.environment AND r.dataset_name = c.dataset_name) GROUP BY environment, dataset_name")
def request_dedup(spark, sf_dir):
    new = load(spark, sf_dir, "consumer_request").select("environment", "dataset_name", "consumer_request_id")
    return R.dedup_requests(new, load(spark, sf_dir, "request"), "consumer_request_id")


@query("reference_count", f"{WITH} SELECT v.version_id, count(r.request_id) AS n_requests, coalesce(string_agg(DISTINCT r.environment, ',' ORDER BY r.environment), '') AS environments FROM version v LEFT JOIN request r ON r.version_id = v.version_id GROUP BY v.version_id")
def reference_count(spark, sf_dir):
    return R.reference_counts(load(spark, sf_dir, "version"), load(spark, sf_dir, "request"))


@query("vacuum_candidates", f"{WITH} SELECT version_id, status, size_bytes AS reclaimable_bytes FROM version WHERE status IN ('expired', 'revoked', 'rolled_back') AND version_id NOT IN (SELECT version_id FROM request)")
def vacuum_candidates(spark, sf_dir):
    return R.vacuum_candidates(load(spark, sf_dir, "version"), load(spark, sf_dir, "request"))


@query("approved_policy", f"{WITH} SELECT policy_version_id, policy_name, version, CASE row_number() OVER (PARTITION BY policy_name ORDER BY version DESC, policy_version_id DESC) WHEN 1 THEN 'approved' ELSE 'superseded' END AS status FROM policy_version WHERE status = 'approved'")
def approved_policy(spark, sf_dir):
    return R.supersede(load(spark, sf_dir, "policy_version"))


@query("consumer_requests_eligible", f"{WITH} SELECT consumer_request_id, policy_version_id IN (SELECT policy_version_id FROM policy_version WHERE status = 'approved') AS accepted FROM consumer_request")
def consumer_requests_eligible(spark, sf_dir):
    return R.eligible(load(spark, sf_dir, "consumer_request"), load(spark, sf_dir, "policy_version")).select("consumer_request_id", "accepted")


_OUTCOMES = "outcomes AS (SELECT r.version_id, reason, CASE WHEN v.status IS NULL THEN 'unknown version' WHEN trim(reason) = '' THEN 'no reason' WHEN v.status IN ('active', 'expired', 'rolled_back') THEN 'revoked' ELSE 'not from ' || v.status END AS outcome FROM revocation r LEFT JOIN {0} v ON v.version_id = r.version_id)"


@query("apply_revocations", f"{WITH}, {_OUTCOMES.format('version')} SELECT coalesce(v.version_id, o.version_id) AS version_id, CASE WHEN o.outcome = 'revoked' THEN 'revoked' ELSE v.status END AS status, CASE WHEN o.outcome = 'revoked' THEN o.reason END AS revoked_reason, o.outcome FROM version v FULL JOIN outcomes o ON o.version_id = v.version_id")
def apply_revocations(spark, sf_dir):
    """All versions in the next snapshot, and the outcome of every revocation, those of unknown versions too."""
    versions = snapshots(spark, sf_dir, "version", "version_id", revoked_reason=F.lit(None).cast("string"))
    asked = load(spark, sf_dir, "revocation")
    outcomes = R.revoke(versions.rows(), asked).select("version_id", "outcome")
    R.revoke_job(versions, asked)
    return versions.rows().select("version_id", "status", "revoked_reason").join(outcomes, "version_id", "full")


@query("snapshot_chain", f"{WITH}, {_FIRST}, one AS (SELECT * REPLACE ({_EXPIRED} AS status) FROM version), {_OUTCOMES.format('one')}, two AS (SELECT v.* REPLACE (CASE WHEN o.outcome = 'revoked' THEN 'revoked' ELSE v.status END AS status) FROM one v LEFT JOIN outcomes o ON o.version_id = v.version_id), {rolled_sql('two')} SELECT v.version_id, v.status AS status_1, one.status AS status_2, two.status AS status_3, coalesce(r.new_status, two.status) AS status_4 FROM version v JOIN one ON one.version_id = v.version_id JOIN two ON two.version_id = v.version_id LEFT JOIN rolled r ON r.version_id = v.version_id")
def snapshot_chain(spark, sf_dir):
    """Expiry, then revocations, then rollbacks on one table: every version in each of its four snapshots."""
    versions = snapshots(spark, sf_dir, "version", "version_id", revoked_reason=F.lit(None).cast("string"))
    requests = snapshots(spark, sf_dir, "request", "request_id")
    chain = [versions.current()[1], R.expire_job(versions, AS_OF), R.revoke_job(versions, load(spark, sf_dir, "revocation")), R.rollback_job(versions, requests, first_commands(spark, sf_dir))[0]]  # a job without changes gives the snapshot before
    out = load(spark, sf_dir, "version").select("version_id")
    for k, snapshot in enumerate(chain, 1):
        out = out.join(versions.rows(snapshot=snapshot).select("version_id", F.col("status").alias(f"status_{k}")), "version_id")
    return out


@query("policy_draft_conflicts", f"{WITH} SELECT policy_version_id, policy_name, version FROM policy_version d WHERE status = 'draft' AND EXISTS (SELECT 1 FROM policy_version p WHERE p.status <> 'draft' AND p.policy_name = d.policy_name AND p.version = d.version)")
def policy_draft_conflicts(spark, sf_dir):
    p = load(spark, sf_dir, "policy_version")
    return p.where("status = 'draft'").join(p.where("status <> 'draft'").select("policy_name", "version"), ["policy_name", "version"], "left_semi").select("policy_version_id", "policy_name", "version")


@query("assign_version_numbers", f"{WITH} SELECT report_id, r.dataset_name, coalesce(m.highest, 0) + row_number() OVER (PARTITION BY r.dataset_name ORDER BY created_at, report_id) AS version_number FROM report r LEFT JOIN (SELECT dataset_name, max(version_number) AS highest FROM version GROUP BY dataset_name) m ON m.dataset_name = r.dataset_name WHERE report_id NOT IN (SELECT report_id FROM version)")
def assign_version_numbers(spark, sf_dir):
    return R.assign_numbers(load(spark, sf_dir, "report"), load(spark, sf_dir, "version"))


@query("max_version", f"{WITH} SELECT dataset_name, max(version_number) AS version_number FROM version GROUP BY dataset_name")
def max_version(spark, sf_dir):
    return load(spark, sf_dir, "version").groupBy("dataset_name").agg(F.max("version_number").alias("version_number"))


@query("status_transition_audit", f"{WITH} SELECT id, event_id, previous, status FROM (SELECT id, event_id, status, lag(status) OVER (PARTITION BY id ORDER BY occurred_at, event_id) AS previous FROM history) WHERE previous IS NOT NULL AND (previous, status) NOT IN ({', '.join(map(str, R.REPORT_CHANGES))})")
def status_transition_audit(spark, sf_dir):
    return R.illegal_transitions(load(spark, sf_dir, "history"), R.REPORT_CHANGES).select("id", "event_id", "previous", "status")


@query("capacity_plan", f"{WITH}, j AS (SELECT v.version_id, size_bytes FROM request r JOIN version v ON v.version_id = r.version_id), s AS (SELECT CAST(sum(size_bytes) AS BIGINT) AS naive_bytes, CAST((SELECT sum(size_bytes) FROM (SELECT DISTINCT version_id, size_bytes FROM j)) AS BIGINT) AS shared_bytes FROM j) SELECT naive_bytes, shared_bytes, naive_bytes - shared_bytes AS saved_bytes, floor((naive_bytes - shared_bytes) / naive_bytes * 1000 + 0.5) / 10 AS saved_percent FROM s")
def capacity_plan(spark, sf_dir):
    return R.capacity_plan(load(spark, sf_dir, "request"), load(spark, sf_dir, "version"))


@query("illustrative_capacity", f"{WITH}, b AS (SELECT CAST(sum(size_bytes) AS DOUBLE) AS baseline FROM version) SELECT n_regionkey AS tier, CAST(sum(floor(baseline * ((n_nationkey % 10 + 1) / 16.0))) AS BIGINT) AS naive_bytes, CAST(floor(max(baseline * ((n_nationkey % 10 + 1) / 16.0))) AS BIGINT) AS shared_bytes FROM nation, b GROUP BY n_regionkey")
def illustrative_capacity(spark, sf_dir):
    environments = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("tier"), ((F.col("n_nationkey") % 10 + 1) / 16.0).alias("pct"))
    return R.illustrative_capacity(environments, load(spark, sf_dir, "version").agg(F.sum("size_bytes").cast("double").alias("baseline")))


_EXTRACT = "CAST(regexp_extract({0}, '\"{1}\":([0-9]+)', 1) AS BIGINT)"


@query("json_map_parse", f"{WITH} SELECT version_id, {_EXTRACT.format('row_counts_json', 'member')} AS member, {_EXTRACT.format('row_counts_json', 'claim')} AS claim FROM version")
def json_map_parse(spark, sf_dir):
    m = load(spark, sf_dir, "version").select("version_id", F.from_json("row_counts_json", "map<string,bigint>").alias("m"))
    return m.select("version_id", F.col("m")["member"].alias("member"), F.col("m")["claim"].alias("claim"))


@query("version_footprint", f"{WITH} SELECT v.version_id, total_rows, total_rows / 5000000.0 AS compute_hours, coalesce(r.environments, '') AS environments FROM version v LEFT JOIN (SELECT version_id, string_agg(DISTINCT environment, ',' ORDER BY environment) AS environments FROM request GROUP BY version_id) r ON r.version_id = v.version_id")
def version_footprint(spark, sf_dir):
    v = load(spark, sf_dir, "version")
    total = v.select("version_id", R.rows_of(F.from_json("row_counts_json", "map<string,bigint>")).alias("total_rows"))
    refs = R.reference_counts(v, load(spark, sf_dir, "request")).select("version_id", "environments")
    return total.withColumn("compute_hours", F.col("total_rows") / R.ROWS_PER_HOUR).join(refs, "version_id")


@query("incremental_delta", f"""{WITH}, long AS (SELECT version_id, 'member' AS entity, {_EXTRACT.format('row_counts_json', 'member')} AS n FROM version UNION ALL SELECT version_id, 'claim', {_EXTRACT.format('row_counts_json', 'claim')} FROM version)
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.entity, b.entity) AS entity, coalesce(before, 0) AS before, coalesce(now, 0) AS now, coalesce(now, 0) - coalesce(before, 0) AS delta, least(coalesce(before, 0), coalesce(now, 0)) AS unchanged
FROM (SELECT version_id // 2 AS pair, entity, n AS before FROM long WHERE version_id % 2 = 0) a FULL JOIN (SELECT version_id // 2 AS pair, CASE WHEN version_id % 10 = 1 THEN 'new-' || entity ELSE entity END AS entity, n AS now FROM long WHERE version_id % 2 = 1) b ON a.pair = b.pair AND a.entity = b.entity""")
def incremental_delta(spark, sf_dir):
    """Odd versions against the even ones before them; some odd ones rename their entities."""
    v = load(spark, sf_dir, "version").select("version_id", F.floor(F.col("version_id") / 2).alias("pair"), F.from_json("row_counts_json", "map<string,bigint>").alias("row_counts"))
    renamed = F.transform_keys("row_counts", lambda k, _: F.concat(F.lit("new-"), k))
    now = v.where("version_id % 2 = 1").withColumn("row_counts", F.when(F.col("version_id") % 10 == 1, renamed).otherwise(F.col("row_counts")))
    return R.incremental_delta(v.where("version_id % 2 = 0"), now, ["pair"])


@query("annual_projection", f"{WITH} SELECT request_id, 365 / ({DAYS.format(c='cadence', i='interval_days')}) AS per_year FROM request")
def annual_projection(spark, sf_dir):
    return load(spark, sf_dir, "request").select("request_id", R.refreshes_per_year(F.col("cadence"), F.col("interval_days")).alias("per_year"))


@query("demand_join", f"{WITH} SELECT request_id, total_rows * (365 / ({DAYS.format(c='cadence', i='interval_days')})) AS annual_rows, total_rows * (365 / ({DAYS.format(c='cadence', i='interval_days')})) / 5000000 AS annual_hours FROM request r JOIN version v ON v.version_id = r.version_id")
def demand_join(spark, sf_dir):
    return R.demand(load(spark, sf_dir, "request"), load(spark, sf_dir, "version"))


_TRAIL = "'source=' || CAST({0} AS VARCHAR(20)) || ' selected=' || CAST({1} AS VARCHAR(20)) || ' final=' || CAST({2} AS VARCHAR(20))"


@query("trail_build_parse", "SELECT o_orderkey, " + _TRAIL.format("o_orderkey + 5", "o_orderkey % 7", "o_orderkey % 9") + " AS trail, CAST(o_orderkey % 9 AS BIGINT) AS final FROM orders")
def trail_build_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    trail = o.select("o_orderkey", F.format_string("source=%d selected=%d final=%d", F.col("o_orderkey") + 5, F.col("o_orderkey") % 7, F.col("o_orderkey") % 9).alias("trail"))
    return trail.withColumn("final", F.regexp_extract("trail", r"final=(\d+)", 1).cast("long"))


@query("registered_count_cross_check", f"{WITH} SELECT version_id, 'claim' AS entity, {_EXTRACT.format('row_counts_json', 'claim')} AS registered, {_EXTRACT.format('row_counts_json', 'claim')} + 1 AS counted FROM version WHERE version_id % 17 = 0")
def registered_count_cross_check(spark, sf_dir):
    """Registered maps against the trail's counts, which are off by one for some claims."""
    v = load(spark, sf_dir, "version").withColumn("m", F.from_json("row_counts_json", "map<string,bigint>"))
    registered = v.select("version_id", F.explode("m").alias("entity", "registered"))
    trail = v.select("version_id", F.explode(F.transform_values("m", lambda k, n: F.format_string("source=9 selected=9 final=%d", n + F.when((k == "claim") & (F.col("version_id") % 17 == 0), 1).otherwise(0)))).alias("entity", "trail"))
    both = registered.join(trail.select("version_id", "entity", F.regexp_extract("trail", r"final=(\d+)", 1).cast("long").alias("counted")), ["version_id", "entity"])
    return both.where("registered <> counted")


@query("rollback_history_join", f"{WITH} SELECT e.event_id, coalesce(a.version_number, 0) AS from_number, coalesce(b.version_number, 0) AS to_number FROM audit e LEFT JOIN version a ON a.version_id = e.event_id * 2 LEFT JOIN version b ON b.version_id = e.event_id WHERE event_type = 'error' ORDER BY occurred_at DESC, e.event_id DESC LIMIT 200")
def rollback_history_join(spark, sf_dir):
    e = R.newest(load(spark, sf_dir, "audit").where("event_type = 'error'"), "occurred_at", "event_id")
    v = load(spark, sf_dir, "version")
    a, b = v.select(F.col("version_id").alias("fv"), F.col("version_number").alias("fn")), v.select(F.col("version_id").alias("tv"), F.col("version_number").alias("tn"))
    return e.join(a, F.col("event_id") * 2 == F.col("fv"), "left").join(b, F.col("event_id") == F.col("tv"), "left").select("event_id", F.coalesce("fn", F.lit(0)).alias("from_number"), F.coalesce("tn", F.lit(0)).alias("to_number"))


@query("policy_version_join", f"{WITH} SELECT v.version_id, p.policy_version_id, p.status FROM version v LEFT JOIN policy_version p ON p.policy_name = v.policy_name AND p.version = v.policy_version AND p.status = 'approved'")
def policy_version_join(spark, sf_dir):
    """Every version with all approved rows of its policy's name and version.

    The result has a row for each pair, so it grows with the product of both tables, and
    what a pair takes in a file decides.  The pairs of a key are cut into cells of bounded
    versions and policies, each one task's, so that a file has few values of either column
    and all of them fit Parquet's dictionaries.  Inside a cell about 168 policies at a time meet
    all its versions: the id of a version is a run, and the ids of the policies repeat
    within a page, however many policies a key has.
    """
    p = load(spark, sf_dir, "policy_version").where("status = 'approved'").select("policy_version_id", "policy_name", F.col("version").alias("policy_version"), "status")
    return R.pairs(load(spark, sf_dir, "version").select("version_id", "policy_name", "policy_version"), p, ["policy_name", "policy_version"], "version_id", "policy_version_id").select("version_id", "policy_version_id", "status")


def _topn(name, where):
    @query(name, f"{WITH} SELECT event_id, event_type, subject, actor FROM audit WHERE {where} ORDER BY occurred_at DESC, event_id DESC LIMIT 200")
    def run(spark, sf_dir):
        return R.newest(load(spark, sf_dir, "audit").where(where), "occurred_at", "event_id").select("event_id", "event_type", "subject", "actor")


_topn("refresh_history_topn", "event_type = 'view' AND subject = 'ds-7'")
_topn("audit_topn", "event_type = 'click' AND actor = 'u3'")
_topn("dead_letter_topn", "event_type = 'error'")


@query("registry_listings", f"{WITH} SELECT version_id, dataset_name, status, row_number() OVER (ORDER BY dataset_name, version_number DESC) AS place FROM version WHERE status = 'active' AND dataset_name < 'ds-2'")
def registry_listings(spark, sf_dir):
    """A listing by two sort keys; places come from range partitions, not from one sorted task."""
    rows = load(spark, sf_dir, "version").where("status = 'active' AND dataset_name < 'ds-2'").select("version_id", "dataset_name", "status", "version_number")
    from pyspark.sql.window import Window

    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("dataset_name").orderBy(F.desc("version_number"))))
    sizes = rows.groupBy("dataset_name").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("dataset_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(before, "dataset_name").select("version_id", "dataset_name", "status", (F.col("own") + F.col("before")).alias("place"))


@query("upcoming_refreshes", f"{WITH} SELECT request_id, next_refresh_at FROM request WHERE next_refresh_at IS NOT NULL ORDER BY next_refresh_at, request_id LIMIT 5")
def upcoming_refreshes(spark, sf_dir):
    return load(spark, sf_dir, "request").where("next_refresh_at IS NOT NULL").orderBy("next_refresh_at", "request_id").limit(5).select("request_id", "next_refresh_at")


@query("audit_trail_union", f"{WITH} SELECT DISTINCT event_id, subject FROM audit WHERE subject IN (SELECT dataset_name FROM request WHERE version_id % 5 = 1) ORDER BY event_id")
def audit_trail_union(spark, sf_dir):
    subjects = load(spark, sf_dir, "request").where("version_id % 5 = 1").select(F.col("dataset_name").alias("subject"))
    return load(spark, sf_dir, "audit").join(subjects, "subject", "left_semi").dropDuplicates(["event_id"]).select("event_id", "subject")


@query("evidence_rollup", f"{WITH} SELECT v.version_id, coalesce(r.n, 0) AS n_requests, coalesce(p.n, 0) AS n_approvals, coalesce(e.n, 0) AS n_events FROM version v LEFT JOIN (SELECT version_id, count(*) AS n FROM request GROUP BY 1) r ON r.version_id = v.version_id LEFT JOIN (SELECT policy_name, version, count(*) AS n FROM policy_version WHERE status = 'approved' GROUP BY 1, 2) p ON p.policy_name = v.policy_name AND p.version = v.policy_version LEFT JOIN (SELECT event_id AS version_id, count(*) AS n FROM audit GROUP BY 1) e ON e.version_id = v.version_id")
def evidence_rollup(spark, sf_dir):
    """One nested record for each version, flattened to the sizes of its parts."""
    v = load(spark, sf_dir, "version")
    requests = load(spark, sf_dir, "request").groupBy("version_id").agg(F.collect_list(F.struct("request_id", "environment")).alias("requests"))
    approvals = load(spark, sf_dir, "policy_version").where("status = 'approved'").groupBy("policy_name", F.col("version").alias("policy_version")).agg(F.collect_list("policy_version_id").alias("approvals"))
    events = load(spark, sf_dir, "audit").groupBy(F.col("event_id").alias("version_id")).agg(F.collect_list(F.struct("event_type", "actor", "occurred_at")).alias("events"))
    nested = v.join(requests, "version_id", "left").join(approvals, ["policy_name", "policy_version"], "left").join(events, "version_id", "left")
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0)).cast("long")
    return nested.select("version_id", size("requests").alias("n_requests"), size("approvals").alias("n_approvals"), size("events").alias("n_events"))


@query("capacity_history", f"{WITH} SELECT date_trunc('month', created_at)::DATE AS month, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(sum(size_bytes)) OVER (ORDER BY date_trunc('month', created_at)) AS BIGINT) AS running_bytes FROM version GROUP BY date_trunc('month', created_at)")
def capacity_history(spark, sf_dir):
    """Plans by month in time order, with the running total; the window sees one row a month."""
    from pyspark.sql.window import Window

    by = load(spark, sf_dir, "version").groupBy(F.trunc("created_at", "month").alias("month")).agg(F.sum("size_bytes").alias("bytes"))
    return by.withColumn("running_bytes", F.sum("bytes").over(Window.orderBy("month")))


@query("bulk_fulfilment", f"{WITH}, own AS (SELECT c.*, coalesce(o.cadence, d.cadence) AS policy_cadence FROM consumer_request c LEFT JOIN policy o ON o.environment = c.environment AND o.dataset_name = c.dataset_name LEFT JOIN policy d ON d.environment = c.environment AND d.dataset_name IS NULL) SELECT consumer_request_id, policy_cadence <> cadence AS overridden, EXISTS (SELECT 1 FROM request r WHERE r.environment = own.environment AND r.dataset_name = own.dataset_name) AS reused, 'fulfilled' AS status FROM own")
def bulk_fulfilment(spark, sf_dir):
    c = R.resolve_policies(load(spark, sf_dir, "consumer_request").withColumn("interval_days", F.lit(None).cast("int")), load(spark, sf_dir, "policy"))
    keys = load(spark, sf_dir, "request").select("environment", "dataset_name").distinct().withColumn("reused", F.lit(True))
    return c.join(keys, ["environment", "dataset_name"], "left").select("consumer_request_id", (F.col("policy_cadence") != F.col("cadence")).alias("overridden"), F.coalesce("reused", F.lit(False)).alias("reused"), F.lit("fulfilled").alias("status"))


@query("catalog_filter", f"{WITH} SELECT column_name, category FROM catalog WHERE dataset = 'ECONOMY' AND category IN ('phi', 'pii') AND confirmed_by IS NULL AND confidence < 0.7")
def catalog_filter(spark, sf_dir):
    c = load(spark, sf_dir, "catalog")
    return c.where((F.col("dataset") == "ECONOMY") & F.col("category").isin("phi", "pii") & needs_review()).select("column_name", "category")


def needs_review():
    return F.col("confirmed_by").isNull() & (F.col("confidence") < 0.7)


@query("needs_review", f"{WITH} SELECT column_name FROM catalog WHERE confirmed_by IS NULL AND confidence < 0.7")
def needs_review_rows(spark, sf_dir):
    return load(spark, sf_dir, "catalog").where(needs_review()).select("column_name")


@query("catalog_summary", f"{WITH} SELECT category, count(*) AS n_columns, count(DISTINCT source_system || '/' || dataset) AS n_datasets, CAST(count_if(confirmed_by IS NULL AND confidence < 0.7) AS BIGINT) AS n_review FROM catalog GROUP BY category UNION ALL SELECT 'all', count(*), count(DISTINCT source_system || '/' || dataset), CAST(count_if(confirmed_by IS NULL AND confidence < 0.7) AS BIGINT) FROM catalog")
def catalog_summary(spark, sf_dir):
    c = load(spark, sf_dir, "catalog")
    sums = [F.count("*").alias("n_columns"), F.countDistinct(F.struct("source_system", "dataset")).alias("n_datasets"), F.count_if(needs_review()).alias("n_review")]
    return c.groupBy("category").agg(*sums).unionByName(c.agg(*sums).withColumn("category", F.lit("all")))


@query("catalog_datasets", f"{WITH} SELECT source_system, dataset, count(*) AS n_columns, CASE min({PLACE}) WHEN 0 THEN 'direct_identifier' WHEN 1 THEN 'quasi_identifier' WHEN 2 THEN 'phi' WHEN 3 THEN 'pii' WHEN 4 THEN 'sensitive' ELSE 'non_sensitive' END AS category, min(owner) AS owner FROM catalog GROUP BY source_system, dataset")
def catalog_datasets(spark, sf_dir):
    return load(spark, sf_dir, "catalog").groupBy("source_system", "dataset").agg(F.count("*").alias("n_columns"), F.min_by("category", F.expr(PLACE)).alias("category"), F.min("owner").alias("owner"))


@query("dataset_classification_summary", f"{WITH} SELECT category, count(*) AS n_columns, CAST(count_if(confirmed_by IS NULL AND confidence < 0.7) AS BIGINT) AS n_review FROM catalog WHERE dataset = 'SMALL' GROUP BY category")
def dataset_classification_summary(spark, sf_dir):
    return load(spark, sf_dir, "catalog").where("dataset = 'SMALL'").groupBy("category").agg(F.count("*").alias("n_columns"), F.count_if(needs_review()).alias("n_review"))


@query("detector_confidence_avg", f"{WITH} SELECT detector, count(*) AS n, floor(sum(CAST(confidence * 100 AS BIGINT)) / count(*) * 100 + 0.5) / 10000 AS confidence FROM catalog GROUP BY detector")
def detector_confidence_avg(spark, sf_dir):
    return load(spark, sf_dir, "catalog").groupBy("detector").agg(F.count("*").alias("n"), (F.floor(F.sum((F.col("confidence") * 100).cast("long")) / F.count("*") * 100 + 0.5) / 10000).alias("confidence"))


@query("run_kpi_rollup", f"{WITH} SELECT dataset_name, CAST(sum(total_rows) AS BIGINT) AS n_rows, CAST(count_if(status = 'active') AS BIGINT) AS n_active, CAST(count_if(status = 'revoked') AS BIGINT) AS n_revoked, CAST(sum(version_id % 13) AS BIGINT) AS gates_passed FROM version GROUP BY dataset_name")
def run_kpi_rollup(spark, sf_dir):
    """Sums over run records; passed gates are counted inside each record's array."""
    gates = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(i.alias("gate"), (i <= F.col("version_id") % 13).alias("passed")))
    v = load(spark, sf_dir, "version").withColumn("gates", gates)
    return v.groupBy("dataset_name").agg(F.sum("total_rows").alias("n_rows"), F.count_if(F.col("status") == "active").alias("n_active"), F.count_if(F.col("status") == "revoked").alias("n_revoked"), F.sum(F.size(F.filter("gates", lambda g: g["passed"]))).cast("long").alias("gates_passed"))
