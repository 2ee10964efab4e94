"""Registry analytics: set-based jobs over snapshots of the registry's tables.

Each analysis reads whole snapshots; the jobs write what they change as the next
snapshot of a table (``sources.snapshots``), and none updates in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stash
from ..sources.snapshots import Snapshot, SnapshotTable

# Status changes that are allowed, by kind of record.
VERSION_CHANGES = [("active", "expired"), ("active", "revoked"), ("active", "rolled_back"), ("rolled_back", "active"), ("rolled_back", "revoked"), ("expired", "revoked")]
REPORT_CHANGES = [("draft", "processing"), ("processing", "certified"), ("processing", "failed"), ("certified", "published"), ("certified", "revoked"), ("published", "revoked")]
# Days between refreshes by cadence; the others have none. Rows that one unit-hour handles.
CADENCE_DAYS = {"weekly": 7, "biweekly": 14, "monthly": 30}
ROWS_PER_HOUR = 5_000_000
# Most rows of either side in a cell of pairs, rows of the right side that are written in turn, pairs and rows of a task.
CELL_LEFT, CELL_RIGHT, BLOCK, TASK_PAIRS, TASK_ROWS = 1 << 14, 1 << 11, 168, 1 << 25, 1 << 16


def retention_expiry(versions: DataFrame, as_of: str) -> DataFrame:
    """Active versions that expire by ``as_of``, with their new status."""
    return versions.where((F.col("status") == "active") & (F.col("expires_at") <= F.lit(as_of).cast("date"))).withColumn("status", F.lit("expired"))


def expire_job(versions: SnapshotTable, as_of: str) -> Snapshot:
    """The snapshot in which active versions whose time has come are expired."""
    return versions.apply(retention_expiry(versions.rows(), as_of).select("version_id", "status"), "retention_expiry")


def revoke_job(versions: SnapshotTable, revocations: DataFrame) -> Snapshot:
    """The snapshot in which the allowed revocations hold; the first reason of a version by its text counts."""
    found = revoke(versions.rows(), revocations).where("outcome = 'revoked'").groupBy("version_id").agg(F.min("reason").alias("revoked_reason"))
    return versions.apply(found.withColumn("status", F.lit("revoked")), "apply_revocations")


def rollback_job(versions: SnapshotTable, requests: SnapshotTable, commands: DataFrame) -> tuple[Snapshot, Snapshot]:
    """The snapshots after the commands: versions left and taken up again, and where the requests point now."""
    held = rollback(requests.rows(), versions.rows(), commands).select("version_id", F.col("new_status").alias("status"))
    moves = valid_commands(requests.rows(), versions.rows(), commands).select("request_id", F.col("target").alias("version_id"))
    return versions.apply(held, "rollback"), requests.apply(moves, "rollback")


def refresh_job(requests: SnapshotTable, versions: DataFrame, policies: DataFrame, as_of: str) -> Snapshot:
    """The snapshot in which due requests point at the latest active version and have their next date; failed ones stay."""
    done = bulk_refresh(requests.rows(), versions, policies, as_of).where("outcome = 'success'")
    return requests.apply(done.select("request_id", F.col("to_version").alias("version_id"), "next_refresh_at"), "bulk_refresh")


def due_refreshes(requests: DataFrame, as_of: str) -> DataFrame:
    return requests.where((F.col("status") == "active") & (F.col("next_refresh_at") <= F.lit(as_of).cast("date")))


def latest_active(versions: DataFrame) -> DataFrame:
    """dataset_name, version_id, version_number of the highest active version."""
    best = F.max_by(F.struct("version_id", "version_number"), "version_number").alias("v")
    return versions.where("status = 'active'").groupBy("dataset_name").agg(best).select("dataset_name", "v.*")


def interval_days(cadence: Column, interval: Column) -> Column:
    default = F.lit(None).cast("int")
    for name, days in CADENCE_DAYS.items():
        default = F.when(cadence == name, days).otherwise(default)
    return F.when(cadence.isin(*CADENCE_DAYS), F.coalesce(interval, default))


def next_refresh(cadence: Column, interval: Column, baseline: Column) -> Column:
    """Baseline plus the interval; release-driven and on-demand have none."""
    return F.date_add(baseline, interval_days(cadence, interval).cast("int"))


def resolve_policies(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Every request with the cadence of its dataset's policy, else of its environment's default."""
    p = policies.select(F.col("environment").alias("pe"), F.col("dataset_name").alias("pd"), F.col("cadence").alias("pc"), F.col("interval_days").alias("pi"))
    own = p.where("pd IS NOT NULL").withColumnsRenamed({"pc": "own_cadence", "pi": "own_interval"})
    default = p.where("pd IS NULL").drop("pd").withColumnsRenamed({"pe": "de", "pc": "default_cadence", "pi": "default_interval"})
    joined = requests.join(own, (F.col("environment") == F.col("pe")) & (F.col("dataset_name") == F.col("pd")), "left").join(default, F.col("environment") == F.col("de"), "left")
    found = F.col("own_cadence").isNotNull()
    return joined.withColumns({"policy_cadence": F.coalesce("own_cadence", "default_cadence"), "policy_interval": F.when(found, F.col("own_interval")).otherwise(F.col("default_interval"))}).drop("pe", "pd", "de", "own_cadence", "own_interval", "default_cadence", "default_interval")


def bulk_refresh(requests: DataFrame, versions: DataFrame, policies: DataFrame, as_of: str) -> DataFrame:
    """For every due request its new version and schedule, or a failed row without an active version."""
    due = resolve_policies(due_refreshes(requests, as_of), policies).join(latest_active(versions).withColumnRenamed("version_id", "to_version"), "dataset_name", "left")
    schedule = next_refresh(F.col("policy_cadence"), F.col("policy_interval"), F.lit(as_of).cast("date"))
    failed = F.col("to_version").isNull()
    return due.select("request_id", "dataset_name", "to_version", F.when(failed, "failed").otherwise("success").alias("outcome"), F.when(failed, "no ACTIVE version").alias("error"), F.when(~failed, schedule).alias("next_refresh_at"))


def valid_commands(requests: DataFrame, versions: DataFrame, commands: DataFrame) -> DataFrame:
    """request_id, target, was of the commands that hold."""
    state = versions.select("version_id", F.col("status").alias("old_status"))
    return commands.join(requests.select("request_id", F.col("version_id").alias("was")), "request_id").join(state, F.col("target") == F.col("version_id")).where("old_status <> 'revoked' AND target <> was").select("request_id", "target", "was")


def rollback(requests: DataFrame, versions: DataFrame, commands: DataFrame) -> DataFrame:
    """version_id, old_status, new_status of every version that the commands change.

    A command (request_id, target) holds if its target exists, is not revoked and is not
    the current version.  A version left by its last request while active is rolled
    back; a rolled-back target becomes active.
    """
    state = versions.select("version_id", F.col("status").alias("old_status"))
    valid = valid_commands(requests, versions, commands)
    moved = requests.join(valid.select("request_id", "target"), "request_id", "left").select(F.coalesce("target", "version_id").alias("version_id"))
    left = state.join(valid.select(F.col("was").alias("version_id")).distinct(), "version_id", "left_semi").where("old_status = 'active'").join(moved, "version_id", "left_anti").withColumn("new_status", F.lit("rolled_back"))
    raised = state.join(valid.select(F.col("target").alias("version_id")).distinct(), "version_id", "left_semi").where("old_status = 'rolled_back'").withColumn("new_status", F.lit("active"))
    return left.unionByName(raised)


def dedup_requests(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """The first new request for each (environment, dataset) that has none yet."""
    first = new.groupBy("environment", "dataset_name").agg(F.min_by(F.struct(*(c for c in new.columns if c not in ("environment", "dataset_name"))), order).alias("r")).select("environment", "dataset_name", "r.*")
    return first.join(existing, ["environment", "dataset_name"], "left_anti")


def reference_counts(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """version_id, n_requests and the environments that point at each version."""
    refs = requests.groupBy("version_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("environment")), ",").alias("environments"))
    return versions.join(refs, "version_id", "left").select("version_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_requests"), F.coalesce("environments", F.lit("")).alias("environments"))


def vacuum_candidates(versions: DataFrame, requests: DataFrame) -> DataFrame:
    gone = versions.where(F.col("status").isin("expired", "revoked", "rolled_back"))
    return gone.join(requests, "version_id", "left_anti").select("version_id", "status", F.col("size_bytes").alias("reclaimable_bytes"))


def supersede(policies: DataFrame) -> DataFrame:
    """Of several approved versions of a policy the highest stays approved, the others are superseded."""
    w = Window.partitionBy("policy_name").orderBy(F.desc("version"), F.desc("policy_version_id"))
    approved = policies.where("status = 'approved'").withColumn("place", F.row_number().over(w))
    return approved.withColumn("status", F.when(F.col("place") == 1, "approved").otherwise("superseded")).drop("place")


def eligible(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Every consumer request with accepted: it names an approved policy version."""
    ok = policies.where("status = 'approved'").select("policy_version_id").distinct()
    return requests.join(ok, "policy_version_id", "left_semi").withColumn("accepted", F.lit(True)).unionByName(requests.join(ok, "policy_version_id", "left_anti").withColumn("accepted", F.lit(False)))


def revoke(versions: DataFrame, revocations: DataFrame) -> DataFrame:
    """version_id, reason, outcome: revoked, or why not."""
    state = versions.select("version_id", "status")
    allowed = [a for a, b in VERSION_CHANGES if b == "revoked"]
    outcome = F.when(F.col("status").isNull(), "unknown version").when(F.trim("reason") == "", "no reason").when(F.col("status").isin(*allowed), "revoked").otherwise(F.concat(F.lit("not from "), F.col("status")))
    return revocations.join(state, "version_id", "left").select("version_id", "reason", outcome.alias("outcome"))


def assign_numbers(reports: DataFrame, versions: DataFrame) -> DataFrame:
    """Numbers for new reports of each dataset, after the highest in use; known reports are left out."""
    new = reports.join(versions.select("report_id"), "report_id", "left_anti")
    highest = versions.groupBy("dataset_name").agg(F.max("version_number").alias("highest"))
    place = F.row_number().over(Window.partitionBy("dataset_name").orderBy("created_at", "report_id"))
    return new.join(highest, "dataset_name", "left").select("report_id", "dataset_name", (F.coalesce("highest", F.lit(0)) + place).alias("version_number"))


def illegal_transitions(history: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """History rows whose status may not follow the one before; the first of each id is free."""
    w = Window.partitionBy("id").orderBy("occurred_at", "event_id")
    pairs = history.withColumn("previous", F.lag("status").over(w)).where("previous IS NOT NULL")
    ok = F.array(*(F.struct(F.lit(a).alias("previous"), F.lit(b).alias("status")) for a, b in allowed))
    return pairs.where(~F.array_contains(ok, F.struct("previous", "status")))


def capacity_plan(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Bytes with a copy for every request, and with one for every version in use."""
    joined = requests.join(versions.select("version_id", "size_bytes"), "version_id")
    by_version = joined.groupBy("version_id").agg(F.count("*").alias("n"), F.first("size_bytes").alias("size"))
    sums = by_version.agg(F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("naive_bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("shared_bytes"))
    saved = F.col("naive_bytes") - F.col("shared_bytes")
    return sums.select("naive_bytes", "shared_bytes", saved.alias("saved_bytes"), F.when(F.col("naive_bytes") > 0, F.floor(saved / F.col("naive_bytes") * 1000 + 0.5) / 10).otherwise(0.0).alias("saved_percent"))


def illustrative_capacity(environments: DataFrame, baseline: DataFrame) -> DataFrame:
    """tier, naive and shared bytes: each environment's share of the baseline, and the largest share of its tier."""
    shares = environments.join(F.broadcast(baseline))  # the baseline is one row
    return shares.groupBy("tier").agg(F.sum(F.floor(F.col("baseline") * F.col("pct"))).alias("naive_bytes"), F.floor(F.max(F.col("baseline") * F.col("pct"))).alias("shared_bytes"))


def rows_of(counts: Column) -> Column:
    """Total of a map of row counts."""
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, v: a + v)


def incremental_delta(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Per entity its rows before and now, the change, and the floor that can stay as it is."""
    old = previous.select(*keys, F.explode("row_counts").alias("entity", "before"))
    new = current.select(*keys, F.explode("row_counts").alias("entity", "now"))
    both = old.join(new, [*keys, "entity"], "full").na.fill(0, ["before", "now"])
    return both.withColumns({"delta": F.col("now") - F.col("before"), "unchanged": F.least("before", "now")})


def refreshes_per_year(cadence: Column, interval: Column) -> Column:
    return 365 / interval_days(cadence, interval)


def demand(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """request_id, annual rows and compute hours; null where the cadence has no interval."""
    per_year = refreshes_per_year(F.col("cadence"), F.col("interval_days"))
    rows = F.col("total_rows") * per_year
    return requests.join(versions.select("version_id", "total_rows"), "version_id").select("request_id", rows.alias("annual_rows"), (rows / ROWS_PER_HOUR).alias("annual_hours"))


def pairs(left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str) -> DataFrame:
    """Left join of two tables that both have many rows of a key, in an order that packs.

    A key's rows are dealt by hash of their ids into cells of bounded sizes, so that a hot
    key is many tasks' and a row travels once for thousands of pairs.  Rows whose key has no
    partner are in column -1; a column that the hash left empty has none.  Blocks of about
    168 rows of either side meet; a task sorts the pairs of blocks, right ones first, and
    only then writes out the rows, so memory does not grow with the pairs.  Parquet packs
    indices in runs of 504, three times a block.
    """
    spark = left.sparkSession
    counts = left.groupBy(key).agg(F.count("*").alias("n")).join(right.groupBy(key).agg(F.count("*").alias("m")).hint("merge"), key, "left").na.fill(0, ["m"])
    sizes = stash(counts.withColumns({"rows_cut": F.ceil(F.col("n") / CELL_LEFT), "cols_cut": F.ceil(F.col("m") / CELL_RIGHT)}), "pair-sizes")
    sums = sizes.agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum(F.col("n") * F.col("cols_cut")).alias("rows")).first()
    tasks = max(spark.sparkContext.defaultParallelism, (sums.pairs or 0) // TASK_PAIRS + (sums.rows or 0) // TASK_ROWS)
    cell = [*key, "cell_row", "cell_col"]
    long = lambda n: F.lit(n).cast("long")
    part = lambda c, cuts: F.pmod(F.xxhash64(c), F.coalesce(cuts, long(1)))
    each = lambda cuts: F.explode(F.when(cuts > 0, F.sequence(long(0), cuts - 1)).otherwise(F.array(long(-1))))

    def blocks(df: DataFrame, by: str, name: str) -> DataFrame:
        """Rows of a cell in arrays, numbered."""
        w = Window.partitionBy(*cell)
        last = F.greatest(F.round(F.count("*").over(w) / BLOCK).cast("long"), long(1)) - 1
        numbered = df.repartition(tasks, *cell).withColumn(f"{name}_block", F.least(F.floor((F.row_number().over(w.orderBy(by)) - 1) / BLOCK), last))
        return numbered.groupBy(*cell, f"{name}_block").agg(F.collect_list(F.struct(*(c for c in df.columns if c not in cell))).alias(f"{name}_rows"))

    cuts = sizes.select(*key, "rows_cut", "cols_cut").hint("merge")
    lefts = left.join(cuts, key, "left").withColumns({"cell_row": part(left_id, F.col("rows_cut")), "cell_col": each(F.col("cols_cut"))}).drop("rows_cut", "cols_cut")
    rights = right.join(cuts, key).withColumns({"cell_row": each(F.col("rows_cut")), "cell_col": part(right_id, F.col("cols_cut"))}).drop("rows_cut", "cols_cut")
    met = blocks(lefts, left_id, "left").join(blocks(rights, right_id, "right").hint("merge"), cell, "left")
    met = met.where("right_rows IS NOT NULL OR cell_col < 0").sortWithinPartitions(*cell, "right_block", "left_block")
    return met.select(*key, "right_rows", F.inline("left_rows")).select("*", F.inline_outer("right_rows")).drop("right_rows")


def newest(df: DataFrame, when: str, key: str, n: int = 200) -> DataFrame:
    """The newest ``n`` rows, ties by key."""
    return df.orderBy(F.desc(when), F.desc(key)).limit(n)
