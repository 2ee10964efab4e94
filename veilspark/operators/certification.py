"""Certification of a selection: profile, classify, close, mask, stage, judge by twelve gates, publish.

Every stage writes what it makes below one run folder, and the next stage reads it from
there: the catalog made in the run decides the masking, and the gates see only what is
on disk.  A run becomes visible through one small pointer file that is swapped by a
rename, so readers see all tables of the old run or all of the new one; a run that
fails a gate leaves the pointer as it is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import pointer
from . import closure as C
from . import gates as G
from . import generate, rules
from . import profile as D
from .masking import BAD_DATE, Masker
from .policy import Rule

TAGS = ("data_provenance", "synthetic_batch_id", "scenario_type")


@dataclass(frozen=True)
class Terms:
    """What a run is held to, and the versions that it records."""

    policy_name: str = "default"
    policy_version: int = 1
    engine_version: str = "1"
    strict: bool = False
    most_orphans: int | None = None
    least_rows: int = 1
    anchor: str = "member"
    numeric: tuple[str, str] | None = ("claim", "billed")
    largest_ratio: float = 10.0
    #: Columns whose raw values may appear in no masked text.
    secrets: tuple[tuple[str, str], ...] = ()


@dataclass
class Run:
    """What the stages of one run have written, as read back; entities by name."""

    folder: str
    sources: dict[str, str]
    masker: Masker
    terms: Terms
    catalog: DataFrame | None = None
    resolved: DataFrame | None = None
    source: dict[str, DataFrame] = field(default_factory=dict)
    subset: dict[str, DataFrame] = field(default_factory=dict)
    final: dict[str, DataFrame] = field(default_factory=dict)
    dangling: DataFrame | None = None
    injected: DataFrame | None = None
    rules: dict[str, dict[str, Rule]] = field(default_factory=dict)
    scenarios: dict[str, DataFrame] = field(default_factory=dict)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(df.sparkSession, name, df)

    def read(self, spark: SparkSession, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = spark.read.schema(like.schema) if like is not None else spark.read
        return reader.parquet(f"{self.folder}/{name}")


def opened(run: Run, folder: str) -> Run:
    """The run as a copy of its folder holds it."""
    spark = run.catalog.sparkSession
    out = replace(run, folder=folder)
    out.catalog, out.resolved, out.dangling = (out.read(spark, n) for n in ("catalog", "resolved", "dangling"))
    out.subset = {n: out.read(spark, f"subset/{n}", df) for n, df in run.subset.items()}
    out.final = {n: out.read(spark, f"final/{n}", df) for n, df in run.final.items()}
    return out


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def counts(frames: dict[str, DataFrame], named: str) -> DataFrame:
    """entity and its rows, one row an entity."""
    return union([df.agg(F.count("*").alias(named)).select(F.lit(name).alias("entity"), named) for name, df in frames.items()])


def profile(frames: dict[str, DataFrame], sources: dict[str, str]) -> DataFrame:
    """entity, source, column_name, n_rows, n_values, and the value detectors that fire, from one pass over each table."""
    parts = []
    for name, df in frames.items():
        hits = lambda c: F.array(*(F.struct(F.lit(d).alias("detector"), F.count_if(F.col(c).rlike(p)).alias("n")) for d, _, _, _, p in D.DETECTORS if p))
        none = F.array().cast("array<struct<detector:string,n:bigint>>")
        text = {c for c, t in df.dtypes if t == "string"}
        stats = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n_values"), (hits(c) if c in text else none).alias("hits")) for c in df.columns]
        parts.append(df.agg(F.count("*").alias("n_rows"), F.array(*stats).alias("x")).select(F.lit(name).alias("entity"), F.lit(sources.get(name)).alias("source"), "n_rows", F.inline("x")))
    found = union(parts)
    return found.withColumn("detectors", F.transform(F.filter("hits", lambda h: h["n"] > 0), lambda h: h["detector"])).drop("hits")


def value_detections(profiled: DataFrame) -> DataFrame:
    """What the detectors of values found, as ``rules.detect`` states what those of names find."""
    known = profiled.sparkSession.createDataFrame([(i, d, c, x) for i, (d, c, x, _, p) in enumerate(D.DETECTORS) if p], "number int, detector string, category string, confidence double")
    asked = profiled.select("entity", "column_name", F.explode("detectors").alias("detector"))
    return asked.join(F.broadcast(known), "detector").select("entity", "column_name", "number", "detector", "category", "confidence")  # a fixed list


def classify(run: Run, frames: dict[str, DataFrame], schema_rules: DataFrame, overrides: DataFrame, owners: DataFrame) -> Run:
    """Profile and classify all columns; the catalog and the rules that follow from it are written."""
    profiled = run.put(profile(frames, run.sources), "profile")
    known = rules.classify(profiled, schema_rules, overrides, value_detections(profiled))
    run.catalog = run.put(rules.catalog(known, owners).drop("detectors"), "catalog")
    run.resolved = run.put(rules.resolve(run.catalog), "resolved")
    run.rules = {}
    for r in run.resolved.select("entity", "column_name", "technique", "field_type", "scope").collect():  # one row a column
        run.rules.setdefault(r.entity, {})[r.column_name] = Rule(r.technique, r.field_type, r.scope)
    return run


def select(run: Run, frames: dict[str, DataFrame], anchors: DataFrame) -> Run:
    """Close the selection over all entities; its rows, its dangling references and its manifest are written."""
    run.source = frames
    chosen = C.closure(frames, run.put(anchors, "anchors"), write=lambda df, name: run.put(df, f"closed/{name}"))
    run.subset = {h.entity: run.put(chosen[h.name], f"subset/{h.entity}") for h in C.HOPS if h.entity in frames}
    run.dangling = run.put(C.dangling({h.name: run.subset[h.entity] for h in C.HOPS if h.entity in run.subset} | run.subset, frames), "dangling")
    manifest = counts(run.subset, "n_selected").join(counts(frames, "n_source"), "entity", "full")
    run.put(manifest, "manifests/subset")
    return run


def write_masked(run: Run, name: str, df: DataFrame, folder: str = "final") -> dict:
    """Mask and write one entity; its record is counted in the same pass: rows, cells by technique, warnings, files."""
    own = run.rules[name]
    whole = {c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint")}
    masked = df.select(*(run.masker.column(F.col(c), own[c], c in whole).alias(c) for c in df.columns))
    shifted = [c for c in df.columns if own[c].technique == "date_shift"]
    if run.scenarios:
        masked = generate.tag_base(masked, "base").withColumn("scenario_type", F.lit(None).cast("string"))
    seen = Observation()
    warnings = [F.count_if(F.col(c) == BAD_DATE).alias(f"w{i}") for i, c in enumerate(shifted)]
    run.final[name] = run.put(masked.observe(seen, F.count(F.lit(1)).alias("n"), *warnings), f"{folder}/{name}")
    got = seen.get
    techniques: dict[str, int] = {}
    for c in df.columns:
        techniques[own[c].technique] = techniques.get(own[c].technique, 0) + got["n"]
    files = pointer.files(df.sparkSession, f"{run.folder}/{folder}/{name}", ".parquet")
    return {"entity": name, "n_rows": got["n"], "n_columns": len(df.columns), "n_warnings": sum(got[f"w{i}"] for i in range(len(shifted))), "n_files": files, "techniques": techniques}


RECORD = "entity string, n_rows long, n_columns int, n_warnings long, n_files int, techniques map<string,bigint>, policy_name string, policy_version int, engine_version string, validation_passed boolean, failures string"


def mask(run: Run) -> Run:
    """Mask every column as the catalog says, check the result, write the record of the run, and add the scenarios."""
    spark = run.catalog.sparkSession
    records = [write_masked(run, name, df) for name, df in run.subset.items()]
    failures = ",".join(r.check_name for r in validate(run).where("n_findings > 0").orderBy("check_name").collect())  # a row a check
    t = run.terms
    rest = {"policy_name": t.policy_name, "policy_version": t.policy_version, "engine_version": t.engine_version, "validation_passed": not failures, "failures": failures}
    run.put(spark.createDataFrame([r | rest for r in records], RECORD), "manifests/masking")  # a row an entity
    for name, extra in run.scenarios.items():
        of = run.final[name].schema
        added = extra.select(*((F.col(c) if c in extra.columns else F.lit(None)).cast(of[c].dataType).alias(c) for c in of.names))
        added.write.mode("append").parquet(f"{run.folder}/final/{name}")
        run.final[name] = run.read(spark, f"final/{name}", run.final[name])
    if run.scenarios:
        tags = union([df.groupBy("data_provenance").agg(F.count("*").alias("n")).select(F.lit(n).alias("entity"), "data_provenance", "n") for n, df in run.final.items()])
        run.put(tags, "manifests/synthetic")
    return run


def links(run: Run, entity: str, columns: list[str]) -> list[DataFrame]:
    df = run.subset[entity]
    return [df.select(F.lit(run.rules[entity][c].scope).alias("scope"), F.col(c).cast("string").alias("original"), run.masker.column(F.col(c), run.rules[entity][c]).cast("string").alias("masked")).where("original IS NOT NULL").distinct() for c in columns]


def linked_columns(run: Run, entity: str) -> list[str]:
    return [c for c in run.subset[entity].columns if run.rules[entity][c].technique == "tokenization"]


def validate(run: Run) -> DataFrame:
    """check_name and n_findings: inconsistent values, collisions, staged values that no selected value gives, raw secrets in masked texts."""
    pairs = run.put(union([x for e in run.subset for x in links(run, e, linked_columns(run, e))]).distinct(), "links")
    base = run.final  # no scenario has been added yet
    held = union([base[e].select(F.lit(run.rules[e][c].scope).alias("scope"), F.col(c).cast("string").alias("masked")).where("masked IS NOT NULL").distinct() for e in base for c in linked_columns(run, e)]).distinct()
    one = lambda name, df: df.agg(F.count("*").alias("n_findings")).select(F.lit(name).alias("check_name"), "n_findings")
    checks = [one("consistency", G.inconsistent(pairs)), one("collisions", G.collisions(pairs)), one("foreign", held.join(pairs, ["scope", "masked"], "left_anti"))]
    if run.terms.secrets:
        raw = union([run.subset[e].select(F.col(c).cast("string").alias("raw")) for e, c in run.terms.secrets])
        texts = G.text_cells(base, TAGS)
        checks.append(one("leaks", G.leaks(texts, "text", raw, "raw")))
    return run.put(union(checks), "validation")


def judge(run: Run) -> DataFrame:
    """The twelve gates over what the run has written."""
    spark, t = run.catalog.sparkSession, run.terms
    verdict = run.put(C.verdict(run.dangling, run.injected), "verdict")
    final = run.put(counts(run.final, "n_final"), "counts")
    manifest = run.read(spark, "manifests/subset") if pointer.exists(spark, f"{run.folder}/manifests/subset/_SUCCESS") else counts(run.subset, "n_selected").where("false").withColumn("n_source", F.col("n_selected"))
    added = union([df.agg(F.count("*").alias("n_added")).select(F.lit(n).alias("entity"), "n_added") for n, df in run.scenarios.items()]) if run.scenarios else None
    expected = manifest.join(added, "entity", "left").fillna(0, ["n_added"]) if added is not None else manifest.withColumn("n_added", F.lit(0))
    both = expected.join(final, "entity", "full")
    written = {n: spark.read.option("mergeSchema", True).parquet(f"{run.folder}/final/{n}").columns for n in run.final}
    uneven = sorted(n for n, df in run.final.items() if written[n] != df.columns)
    orphans = F.col("source_orphan") + F.col("negative_test")
    engine_bug = F.col("engine_bug") + (orphans if t.strict else F.lit(0))
    kinds = ["subset", "masking", *(["synthetic"] if run.scenarios else [])]
    missing = [k for k in kinds if not pointer.exists(spark, f"{run.folder}/manifests/{k}/_SUCCESS")]
    masking = run.read(spark, "manifests/masking") if "masking" not in missing else None
    one_row = spark.range(1)
    recorded = masking if masking is not None else one_row.select(F.lit("").alias("policy_name"), F.lit(0).alias("policy_version"), F.lit("").alias("engine_version"))
    totals = final.agg(F.sum("n_final").alias("n"), F.max(F.when(F.col("entity") == t.anchor, F.col("n_final"))).alias("anchor"))
    masked_rows = (masking if masking is not None else one_row.select(F.lit(0).alias("n_rows"), F.lit(0).alias("n_files"))).agg(F.sum("n_rows").alias("n"), F.sum("n_files").alias("files"))
    findings = run.read(spark, "validation").agg(F.sum("n_findings").alias("findings"))
    if run.scenarios:
        tagged = (run.read(spark, "manifests/synthetic") if "synthetic" not in missing else one_row.select(F.lit(None).cast("string").alias("data_provenance"), F.lit(0).alias("n"))).where("data_provenance IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tagged"))
        provenance = G.gate(tagged.join(F.broadcast(totals)), "provenance", F.col("tagged") == F.col("n"), F.col("tagged"))
    else:
        provenance = G.gate(one_row, "provenance", F.lit(True), F.lit("no scenarios"))
    shape = G.gate(one_row, "distribution_shape", F.lit(True), F.lit("no column"))
    if t.numeric:
        e, c = t.numeric
        base = run.final[e].where(F.col("scenario_type").isNull()) if run.scenarios else run.final[e]
        shape = G.mean_ratio(D.numeric_profile(run.subset[e], c, "source").join(F.broadcast(D.numeric_profile(base, c, "masked"))), t.largest_ratio)
    gates = [
        G.policy_coverage(run.resolved),
        G.gate(masked_rows.join(F.broadcast(findings)), "masking_completion", (F.col("n") > 0) & (F.col("files") > 0) & (F.col("findings") == 0), F.col("findings")),
        G.gate(verdict, "referential_integrity", engine_bug == 0, F.col("engine_bug")),
        G.gate(both.agg(F.count_if(~(F.coalesce(F.col("n_selected") + F.col("n_added"), F.lit(-1)) == F.coalesce("n_final", F.lit(-1)))).alias("n")), "schema_validation", (F.col("n") == 0) & F.lit(not uneven), F.concat_ws(",", F.col("n").cast("string"), *map(F.lit, uneven))),
        G.gate(totals, "data_quality_thresholds", (F.coalesce("n", F.lit(0)) >= t.least_rows) & (F.coalesce("anchor", F.lit(0)) > 0), F.col("n")),
        G.gate(both.agg(F.count_if(F.coalesce("n_final", F.lit(0)) < F.col("n_selected")).alias("n"), F.count("n_selected").alias("known")), "row_count_reconciliation", (F.col("n") == 0) & (F.col("known") > 0), F.col("n")),
        G.gate(verdict, "orphan_detection", F.lit(t.most_orphans is None) | (orphans <= F.lit(t.most_orphans)), orphans),
        provenance,
        G.gate(one_row, "manifest_generation", F.lit(not missing), F.lit(",".join(missing))),
        G.gate(recorded.agg(F.count_if((F.coalesce("policy_name", F.lit("")) == "") | (F.col("policy_version") < 1)).alias("n")), "policy_version_recorded", F.col("n") == 0, F.col("n")),
        G.gate(recorded.agg(F.count_if(F.trim("engine_version") == "").alias("n")), "masking_version_recorded", F.col("n") == 0, F.col("n")),
        shape,
    ]
    return run.put(union(gates).withColumn("passed", F.coalesce("passed", F.lit(False))), "gates")


def publish(spark: SparkSession, root: str, run: Run, gates: DataFrame) -> str:
    """certified or failed; only a certified run becomes the one that readers see."""
    status = G.certify(gates).first()["status"]
    if status == "certified":
        pointer.swap(spark, root, run.folder)
    return status


def published(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """All tables of the run that the pointer names; none where nothing was published."""
    folder = pointer.read(spark, root)
    return None if folder is None else {name: spark.read.parquet(f"{folder}/final/{name}") for name in pointer.children(spark, f"{folder}/final")}


def certify(root: str, frames: dict[str, DataFrame], sources: dict[str, str], anchors: DataFrame, masker: Masker, schema_rules: DataFrame, overrides: DataFrame, owners: DataFrame, terms: Terms = Terms(), scenarios: dict[str, DataFrame] | None = None) -> tuple[Run, DataFrame, str]:
    """(run, gates, status) of one whole run below ``root``.

    ``frames`` are the entities of closure.HOPS; ``scenarios`` are tagged rows of the
    masked shape that are added to entities.  Runs never write to each other's folders,
    and a repeated task writes the same rows.
    """
    spark = anchors.sparkSession
    run = Run(f"{root}/runs/{uuid.uuid4().hex}", sources, masker, terms, scenarios=scenarios or {})
    select(classify(run, frames, schema_rules, overrides, owners), frames, anchors)
    mask(run)
    gates = judge(run)
    return run, gates, publish(spark, root, run, gates)


def report(run: Run, gates: DataFrame, status: str) -> DataFrame:
    """One row a gate, then one an entity with its rows at source, selected and final, and the run's status."""
    spark = gates.sparkSession
    trail = run.read(spark, "manifests/subset").join(run.read(spark, "counts"), "entity", "full")
    none = F.lit(None).cast("long")
    first = gates.select(F.lit("gate").alias("part"), F.col("gate").alias("name"), "passed", "detail", none.alias("n_source"), none.alias("n_selected"), none.alias("n_final"))
    second = trail.select(F.lit("entity").alias("part"), F.col("entity").alias("name"), F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("string").alias("detail"), "n_source", "n_selected", "n_final")
    return first.unionByName(second).withColumn("status", F.lit(status))
