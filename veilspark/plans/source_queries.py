"""Scans and sinks: each query writes tables in a source's shape and reads them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..sources import readers as R
from ..sources import writers as W
from ..sources.snapshots import SnapshotTable
from ..sources.shared import folder
from .base import ESTATE, ORACLES, QUERIES, WITH, entity, query
from .masking_queries import MASKER, TIERS, ids, ids_sql
from .registry_queries import WITH as REGISTRY_WITH
from .registry_queries import load as registry

ENROLLMENT = ["member", "member_demographics", "address", "coverage", "plan", "provider"]


def counted(frames: dict[str, DataFrame], name: str = "entity") -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias(name), "n_rows") for k, df in frames.items()])


def counts_sql(names, with_=WITH):
    return f"{with_} " + " UNION ALL ".join(f"SELECT '{n}' AS entity, count(*) AS n_rows FROM {n}" for n in names)


def enrollment(spark, sf_dir):
    root, frames = folder(spark, "enrollment"), {n: entity(spark, sf_dir, n) for n in ENROLLMENT}
    W.write_relational(frames, root)
    return root, frames


@query("scan_enrollment", f"{counts_sql(ENROLLMENT)} UNION ALL SELECT 'absent', 0")
def scan_enrollment(spark, sf_dir):
    root, frames = enrollment(spark, sf_dir)
    read = {n: R.read_relational(spark, root, n, df.schema) for n, df in frames.items()}
    return counted(read | {"absent": R.read_relational(spark, root, "absent", frames["plan"].schema)})


@query("sink_enrollment", f"{WITH} SELECT coverage_id, member_id, plan_id, status FROM coverage")
def sink_enrollment(spark, sf_dir):
    root, frames = enrollment(spark, sf_dir)
    return R.read_relational(spark, root, "coverage", frames["coverage"].schema)


def claims_root(spark, sf_dir):
    root = folder(spark, "claims")
    W.write_drift_batches(entity(spark, sf_dir, "claim").select("claim_id", "member_id", "status", F.col("billed").alias("paid"), "batch"), root, "2024Q4")
    return root


_DRIFT = "SELECT claim_id, batch, CASE WHEN batch = '2024Q4' THEN billed END AS paid_amount, CASE WHEN batch <> '2024Q4' THEN billed END AS amount_paid FROM claim"


@query("drift_batch_sink", f"{WITH} {_DRIFT}")
def drift_batch_sink(spark, sf_dir):
    return R.read_batches(spark, claims_root(spark, sf_dir)).select("claim_id", "batch", "paid_amount", "amount_paid")


@query("scan_claims_parquet", f"{WITH} SELECT batch, count(*) AS n_rows, CAST(sum(CAST(round(billed * 100) AS BIGINT)) AS BIGINT) AS cents FROM claim GROUP BY batch")
def scan_claims_parquet(spark, sf_dir):
    read = R.read_batches(spark, claims_root(spark, sf_dir))
    return read.groupBy("batch").agg(F.count("*").alias("n_rows"), F.sum(F.round(F.coalesce("paid_amount", "amount_paid") * 100).cast("long")).alias("cents"))


@query("scan_merge_schema", f"{WITH} SELECT count(*) AS n_rows, count(CASE WHEN batch = '2024Q4' THEN 1 END) AS n_legacy, count(CASE WHEN batch <> '2024Q4' THEN 1 END) AS n_current, CAST(7 AS BIGINT) AS n_columns FROM claim")
def scan_merge_schema(spark, sf_dir):
    read = spark.read.option("mergeSchema", "true").parquet(claims_root(spark, sf_dir))
    return read.agg(F.count("*").alias("n_rows"), F.count("paid_amount").alias("n_legacy"), F.count("amount_paid").alias("n_current"), F.lit(len(read.columns)).cast("long").alias("n_columns"))


@query("sink_parquet_partitioned", f"{WITH} SELECT claim_id, member_id, batch FROM claim")
def sink_parquet_partitioned(spark, sf_dir):
    root = folder(spark, "partitioned")
    W.write_partitioned(entity(spark, sf_dir, "claim").select("claim_id", "member_id", "batch"), root)
    return spark.read.parquet(root)


def claims_files(spark, sf_dir) -> dict[str, DataFrame]:
    """Claims by batch, lines and codes, written and read back."""
    read = {"claim": R.read_batches(spark, claims_root(spark, sf_dir))}
    for n in ("claim_line", "code"):
        root = folder(spark, n)
        W.write_partitioned(entity(spark, sf_dir, n), root)
        read[n] = spark.read.parquet(root)
    return read


QUERIES["sink_claims_parquet"] = lambda spark, sf_dir: counted(claims_files(spark, sf_dir))
ORACLES["sink_claims_parquet"] = counts_sql(["claim", "claim_line", "code"])


@query("scan_ndjson", f"{WITH} SELECT encounter_id, member_id, discharge_date FROM encounter")
def scan_ndjson(spark, sf_dir):
    df, root = entity(spark, sf_dir, "encounter"), folder(spark, "ndjson")
    W.write_ndjson(df, root)
    return R.read_ndjson(spark, root, df.schema).where("_corrupt_record IS NULL AND encounter_id IS NOT NULL").select("encounter_id", "member_id", "discharge_date")


@query("sink_ndjson", f"{WITH} SELECT lab_id, member_id, result FROM lab_ehr")
def sink_ndjson(spark, sf_dir):
    df, root = entity(spark, sf_dir, "lab_ehr").select("lab_id", "member_id", "result"), folder(spark, "ndjson")
    W.write_ndjson(df, root)
    return R.read_ndjson(spark, root, df.schema).drop("_corrupt_record")


def pbm(spark, sf_dir, name, columns):
    df, root = entity(spark, sf_dir, name).select(*columns), folder(spark, "pbm")
    W.write_csv(df, root)
    return R.read_csv_strings(spark, root, columns)


@query("scan_csv_all_string", f"{WITH} SELECT CAST(rx_id AS VARCHAR) AS rx_id, CAST(member_id AS VARCHAR) AS member_id, CAST(pharmacy_id AS VARCHAR) AS pharmacy_id FROM prescription")
def scan_csv_all_string(spark, sf_dir):
    return pbm(spark, sf_dir, "prescription", ["rx_id", "member_id", "pharmacy_id"])


@query("sink_csv", f"{WITH} SELECT CAST(pharmacy_id AS VARCHAR) AS pharmacy_id, pharmacy_name FROM pharmacy")
def sink_csv(spark, sf_dir):
    return pbm(spark, sf_dir, "pharmacy", ["pharmacy_id", "pharmacy_name"])


def partner(spark, sf_dir):
    """The feed in both shapes, read back as (v1, v2)."""
    return partner_feed(spark, entity(spark, sf_dir, "lab_partner_v1").select("lab_id", "pat_id", "result"), entity(spark, sf_dir, "lab_partner_v2").select("lab_id", "member_id", "result"))


def partner_feed(spark, v1, v2):
    root = folder(spark, "partner")
    W.write_partner_feed(v1, v2, root)
    return R.read_partner_feed(spark, root, dict(v1.dtypes), v2.schema, old="*.csv", new="*.txt", lines=True)


_FEED = "SELECT lab_id, pat_id AS member_id, result, 'v1' AS shape FROM lab_partner_v1 UNION ALL SELECT lab_id, member_id, result, 'v2' FROM lab_partner_v2"


@query("scan_partner_feed", f"{WITH} {_FEED}")
def scan_partner_feed(spark, sf_dir):
    one, two = partner(spark, sf_dir)
    return one.select("lab_id", F.col("pat_id").alias("member_id"), "result", F.lit("v1").alias("shape")).unionByName(two.select("lab_id", "member_id", "result", F.lit("v2").alias("shape")))


@query("sink_partner_feed", f"{WITH} SELECT shape, count(*) AS n_rows, true AS named FROM ({_FEED}) GROUP BY shape")
def sink_partner_feed(spark, sf_dir):
    one, two = partner(spark, sf_dir)
    both = one.select(F.lit("v1").alias("shape"), "source_file").unionByName(two.select(F.lit("v2").alias("shape"), "source_file"))
    return both.groupBy("shape").agg(F.count("*").alias("n_rows"), (F.count("source_file") == F.count("*")).alias("named"))


@query("partner_two_shape_sink", f"{WITH} SELECT lab_id, CAST(member_id AS VARCHAR) AS member, shape FROM ({_FEED})")
def partner_two_shape_sink(spark, sf_dir):
    """One lab table split by schema version into abbreviated and full columns."""
    all_ = scan_partner_feed(spark, sf_dir)
    v1 = all_.where("shape = 'v1'").select("lab_id", F.col("member_id").alias("pat_id"))
    v2 = all_.where("shape = 'v2'").select("lab_id", "member_id")
    return v1.select("lab_id", F.col("pat_id").cast("string").alias("member"), F.lit("v1").alias("shape")).unionByName(v2.select("lab_id", F.col("member_id").cast("string").alias("member"), F.lit("v2").alias("shape")))


_PAYLOAD = "CASE event_id % 17 WHEN 3 THEN '{\"lab_id\":' || CAST(event_id AS VARCHAR(20)) || '}' WHEN 5 THEN '[{\"lab_id\":' WHEN 7 THEN '[]' ELSE '[{\"lab_id\":' || CAST(event_id AS VARCHAR(20)) || '},{\"lab_id\":' || CAST(event_id AS VARCHAR(20)) || '}]' END"


@query("partner_refused_payloads", "SELECT CASE WHEN event_id % 17 = 3 THEN 'no array' WHEN event_id % 17 = 5 THEN 'broken' ELSE 'accepted' END AS reason, CAST(sum(CASE event_id % 17 WHEN 3 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN 0 ELSE 2 END) AS BIGINT) AS n FROM events GROUP BY 1")
def partner_refused_payloads(spark, sf_dir):
    """Deliveries of which some are no array or broken: rows of the good ones, and the others counted by reason."""
    root = folder(spark, "payloads")
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_PAYLOAD).alias("value")).write.text(root)
    rows, lost = R.accepted(R.payloads(spark, root, "*.txt", lines=True), StructType().add("lab_id", LongType()))
    count = lambda df, c: df.groupBy(c.alias("reason")).agg(F.count("*").alias("n"))
    return count(rows, F.lit("accepted")).unionByName(count(lost, F.col("reason")))


def sink_whole(spark, sf_dir) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All entities but the partner feed written in the shapes of their sources; all frames, and the folder of each."""
    frames, roots = {n: entity(spark, sf_dir, n) for n in ESTATE}, {n: folder(spark, f"estate-{n}") for n in ESTATE}
    for n in ENROLLMENT:
        W.write_relational({n: frames[n]}, roots[n])
    for n in ("claim", "claim_line", "code"):
        W.write_partitioned(frames[n], roots[n])
    for n in ("encounter", "lab_ehr"):
        W.write_ndjson(frames[n], roots[n])
    for n in ("prescription", "pharmacy"):
        W.write_csv(frames[n], roots[n])
    return frames, roots


def read_whole(spark, frames: dict[str, DataFrame], roots: dict[str, str]) -> dict[str, DataFrame]:
    """All fifteen entities read back; the partner feed is written in its two shapes and read at once."""
    read = {n: R.read_relational(spark, roots[n], n, frames[n].schema) for n in ENROLLMENT}
    read |= {n: spark.read.parquet(roots[n]) for n in ("claim", "claim_line", "code")}
    read |= {n: R.read_ndjson(spark, roots[n], frames[n].schema).drop("_corrupt_record") for n in ("encounter", "lab_ehr")}
    for n, df in zip(("lab_partner_v1", "lab_partner_v2"), partner_feed(spark, frames["lab_partner_v1"], frames["lab_partner_v2"]), strict=True):
        read[n] = df.drop("source_file")
    return read | {n: R.read_csv_strings(spark, roots[n], frames[n].columns) for n in ("prescription", "pharmacy")}


@query("load_estate", f"{WITH} " + " UNION ALL ".join(f"SELECT '{n}' AS entity, count(*) AS n_rows, CAST({len(c)} AS BIGINT) AS n_columns FROM {n}" for n, (_, c, _) in ESTATE.items()))
def load_estate(spark, sf_dir):
    """Every entity read from its source's shape: rows and columns."""
    read = read_whole(spark, *sink_whole(spark, sf_dir))
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("entity"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns")) for n, df in read.items()])


@query("sink_estate", counts_sql(ESTATE))
def sink_estate(spark, sf_dir):
    return counted(read_whole(spark, *sink_whole(spark, sf_dir)))


@query("estate_sink_all", f"{WITH} " + " UNION ALL ".join(f"SELECT '{n}' AS entity, count(*) AS n_rows, true AS complete FROM {n}" for n in ESTATE))
def estate_sink_all(spark, sf_dir):
    """The whole estate with a manifest of its row counts, held against what is read back."""
    frames, roots = sink_whole(spark, sf_dir)
    manifest = folder(spark, "estate-manifest")
    W.write_ndjson(counted(frames), manifest)
    told = spark.read.schema("entity string, n_rows long").json(manifest).withColumnRenamed("n_rows", "told")
    return counted(read_whole(spark, frames, roots)).join(told, "entity", "left").select("entity", "n_rows", (F.col("n_rows") == F.col("told")).alias("complete"))


@query("atomic_publish", f"{WITH} SELECT count(*) AS n_rows, false AS broken_visible FROM claim")
def atomic_publish(spark, sf_dir):
    """A good publication is there whole; one that fails leaves nothing."""
    good, broken = folder(spark, "published"), folder(spark, "broken")
    W.publish(spark, good, lambda path: entity(spark, sf_dir, "claim").write.parquet(path))

    def fail(path):
        entity(spark, sf_dir, "plan").write.parquet(path)
        raise RuntimeError("stopped before the end")

    try:
        W.publish(spark, broken, fail)
    except RuntimeError:
        pass
    return spark.read.parquet(good).agg(F.count("*").alias("n_rows")).withColumn("broken_visible", F.lit(R.exists(spark, broken)))


@query("run_complete_marker", f"{WITH} SELECT count(*) AS n_rows, true AS complete, false AS absent_complete FROM coverage")
def run_complete_marker(spark, sf_dir):
    root = folder(spark, "run")
    entity(spark, sf_dir, "coverage").write.parquet(root)
    return spark.read.parquet(root).agg(F.count("*").alias("n_rows")).withColumns({"complete": F.lit(R.is_complete(spark, root)), "absent_complete": F.lit(R.is_complete(spark, f"{root}-none"))})


@query("catalog_sink", f"{REGISTRY_WITH} SELECT source_system, dataset, column_name, category FROM catalog")
def catalog_sink(spark, sf_dir):
    """The catalog as one JSON object a column, read back by its schema."""
    df, root = registry(spark, sf_dir, "catalog").select("source_system", "dataset", "column_name", "category"), folder(spark, "catalog")
    W.write_ndjson(df, root)
    return spark.read.schema(df.schema).json(root)


@query("catalog_scan", f"{REGISTRY_WITH} SELECT source_system, dataset, column_name, category, CASE WHEN confirmed_by IS NULL AND confidence >= 0.9 THEN 'second run' ELSE confirmed_by END AS confirmed_by FROM catalog")
def catalog_scan(spark, sf_dir):
    """A catalog that one run wrote and another confirmed in part, as a third finds it by its folder alone."""
    root = folder(spark, "catalog")
    first = registry(spark, sf_dir, "catalog").select("source_system", "dataset", "column_name", "category", "confidence", "confirmed_by")
    SnapshotTable.create(spark, root, first, "column_name", buckets=16)
    second = SnapshotTable(spark, root)
    second.apply(second.rows().where("confirmed_by IS NULL AND confidence >= 0.9").select("column_name", F.lit("second run").alias("confirmed_by")), "confirm")
    return SnapshotTable(spark, root).rows().drop("confidence")


@query("manifest_scan", f"{REGISTRY_WITH} SELECT CASE WHEN version_id % 2 = 0 THEN 'subset' ELSE 'masking' END AS kind, count(*) AS n_manifests, CAST(sum(total_rows) AS BIGINT) AS n_rows FROM version GROUP BY 1")
def manifest_scan(spark, sf_dir):
    """Manifests of two kinds below one root, found again by folder with their source path."""
    root, v = folder(spark, "manifests"), registry(spark, sf_dir, "version").select("version_id", "total_rows")
    for kind, rest in (("subset", 0), ("masking", 1)):
        v.where(F.col("version_id") % 2 == rest).write.json(f"{root}/runs/{kind}")
    found = spark.read.schema(v.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root).select("*", F.col("_metadata.file_path").alias("source_path"))
    return found.groupBy(F.regexp_extract("source_path", r"/runs/(\w+)/", 1).alias("kind")).agg(F.count("*").alias("n_manifests"), F.sum("total_rows").alias("n_rows"))


#: A fixed-width copy of the pharmacies and claims, whose CSV bytes SQL can tell exactly.
_PLAIN = f"{WITH}, plain AS (SELECT 'pharmacy' AS dataset, lpad(CAST(pharmacy_id AS VARCHAR), 12, '0') AS id, 0 AS part FROM pharmacy UNION ALL SELECT 'claim', lpad(CAST(claim_id AS VARCHAR), 12, '0'), claim_id % 3 FROM claim), sized AS (SELECT dataset, part, CAST(sum(length(id) + 1) AS BIGINT) AS bytes FROM plain GROUP BY dataset, part)"


def plain_files(spark, sf_dir):
    """path and length of the files of fixed-width rows: text by part for claims, CSV for pharmacies."""
    root = folder(spark, "plain")
    fixed = lambda e, c: entity(spark, sf_dir, e).select(F.lpad(F.col(c).cast("string"), 12, "0").alias("value"), (F.col(c) % 3).alias("part"))
    fixed("claim", "claim_id").write.partitionBy("part").text(f"{root}/claim")
    fixed("pharmacy", "pharmacy_id").select("value").write.csv(f"{root}/pharmacy")
    return R.list_files(spark, root).where(~F.col("path").contains("/_"))


def by_extension(files):
    return files.groupBy(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("extension")).agg(F.sum("length").alias("n_bytes"))


@query("file_listing", f"{_PLAIN} SELECT dataset, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM sized GROUP BY dataset")
def file_listing(spark, sf_dir):
    return plain_files(spark, sf_dir).groupBy(F.regexp_extract("path", r"/(claim|pharmacy)/", 1).alias("dataset")).agg(F.sum("length").alias("n_bytes"))


@query("footprint_by_extension", f"{_PLAIN} SELECT CASE dataset WHEN 'claim' THEN 'txt' ELSE 'csv' END AS extension, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM sized GROUP BY 1")
def footprint_by_extension(spark, sf_dir):
    return by_extension(plain_files(spark, sf_dir))


@query("partition_summary", f"{_PLAIN} SELECT 'part' AS key, CAST(part AS VARCHAR) AS value, bytes AS n_bytes FROM sized WHERE dataset = 'claim'")
def partition_summary(spark, sf_dir):
    """Bytes of every partition; files outside partitions are left out."""
    part = lambda k: F.regexp_extract("path", r"/([A-Za-z0-9_]+)=([^/]+)/", k)
    files = plain_files(spark, sf_dir).select(part(1).alias("key"), part(2).alias("value"), "length").where("key <> ''")
    return files.groupBy("key", "value").agg(F.sum("length").alias("n_bytes"))


@query("storage_bytes", f"{_PLAIN} SELECT CAST(sum(bytes) AS BIGINT) AS n_bytes FROM sized")
def storage_bytes(spark, sf_dir):
    return plain_files(spark, sf_dir).agg(F.sum("length").alias("n_bytes"))


@query("compression_ratio", "SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + length(o_orderstatus) + length(CAST(o_custkey AS VARCHAR)) + 3) AS BIGINT) AS csv_bytes, true AS has_ratio FROM orders")
def compression_ratio(spark, sf_dir):
    """Bytes of the rows as CSV against the bytes of their Parquet files."""
    root = folder(spark, "ratio")
    from .base import table

    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey").write.parquet(root)
    read = spark.read.parquet(root)
    size = read.select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
    rows = size.groupBy("f").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_csv(F.struct("o_orderkey", "o_orderstatus", "o_custkey"))) + 1).alias("csv"), F.first("s").alias("s"))
    return rows.agg(F.sum("n").alias("n_rows"), F.lit(len(read.columns)).cast("long").alias("n_columns"), F.sum("csv").alias("csv_bytes"), (F.sum("csv") / F.sum("s") > 0).alias("has_ratio"))


# Masking per source: read, mask, write in the same shape, read back

def _masked(name, entities, write, read):
    @query(f"mask_source_{name}", f"{WITH} {ids_sql(entities)}")
    def run(spark, sf_dir):
        out = []
        for e in entities:
            df, root = MASKER.table(entity(spark, sf_dir, e).select(*TIERS[e]), TIERS[e]), folder(spark, f"{e}-masked")
            write(e, df, root)
            out.append(ids(e, read(spark, e, df, root)))
        return reduce(DataFrame.unionByName, out)


_masked("postgres_enrollment", ENROLLMENT, lambda e, df, root: W.write_relational({e: df}, root), lambda spark, e, df, root: R.read_relational(spark, root, e, df.schema))
_masked("claims_parquet", ["claim", "claim_line", "code"], lambda e, df, root: W.write_partitioned(df, root), lambda spark, e, df, root: spark.read.parquet(root))
_masked("clinical_data_lake", ["encounter", "lab_ehr"], lambda e, df, root: W.write_ndjson(df, root), lambda spark, e, df, root: R.read_ndjson(spark, root, df.schema))
_masked("pbm_extract", ["prescription", "pharmacy"], lambda e, df, root: W.write_csv(df, root), lambda spark, e, df, root: R.read_csv_strings(spark, root, df.columns))


@query("mask_source_partner_lab_feed", f"{WITH} {ids_sql(['lab_partner_v1', 'lab_partner_v2'])}")
def mask_source_partner_lab_feed(spark, sf_dir):
    names = ("lab_partner_v1", "lab_partner_v2")
    read = partner_feed(spark, *(MASKER.table(entity(spark, sf_dir, n).select(*TIERS[n]), TIERS[n]) for n in names))
    return ids(names[0], read[0]).unionByName(ids(names[1], read[1]))
