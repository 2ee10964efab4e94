"""Data generation: rows derived from seed rows by hashed columns.

Every value is an expression over the seed row's number and a tag, so any partitioning
gives the same rows, and any row can be made again alone.  Templates are SQL with
placeholders, rendered for Spark or for a check in another engine:

``{u:tag}`` a uniform number in [0, 1), ``{n:tag:k}`` a whole number below k,
``{pick:list:tag}`` an entry of a list, ``{money:tag:low:high}`` an amount in cents
steps, ``{id:prefix}`` an identifier that counts from the row's number.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTS = {
    "status": ["paid", "paid", "paid", "pending", "denied"],
    "plan_type": ["HMO", "PPO", "EPO", "POS"],
    "specialty": ["Family", "Cardiology", "Pediatrics", "Surgery", "Behavioral Health"],
    "gender": ["F", "M", "U"],
    "drug": ["Amoxil", "Zestor", "Lipanol", "Metfora", "Oxivan"],
    "test": ["A1C", "LDL", "TSH", "CBC"],
    "city": ["Ashford", "Bramley", "Colton", "Dunmore"],
}
PAIRS = [("Warfin", "Aspira"), ("Clarimax", "Simvasta"), ("Litharo", "Ibuprel")]


@dataclass(frozen=True)
class Dialect:
    """How an engine reads a hex number and a list entry, and repeats a row."""

    hex_number: str
    entry: Callable[[list[str], str], str]


SPARK = Dialect("CAST(conv(substr(md5('{seed}:{tag}:' || CAST({i} AS STRING)), 1, 8), 16, 10) AS BIGINT)", lambda names, k: f"element_at(array({', '.join(map(repr, names))}), CAST({k} AS INT) + 1)")
DUCKDB = Dialect("CAST('0x' || substr(md5('{seed}:{tag}:' || CAST({i} AS VARCHAR)), 1, 8) AS BIGINT)", lambda names, k: f"[{', '.join(map(repr, names))}][{k} + 1]")


def render(template: str, dialect: Dialect, seed: int, i: str = "i") -> str:
    def one(m: re.Match) -> str:
        kind, *args = m[1].split(":")
        if kind == "id":
            return f"'{args[0]}-' || lpad(CAST({i} AS VARCHAR(20)), CAST(greatest(6, length(CAST({i} AS VARCHAR(20)))) AS INT), '0')"
        tag = args[1] if kind == "pick" else args[0]
        number = dialect.hex_number.format(seed=seed, tag=tag, i=i)
        if kind == "u":
            return f"({number} / 4294967296.0D)" if dialect is SPARK else f"({number} / 4294967296.0)"
        if kind == "n":
            return f"({number} % {args[1]})"
        if kind == "pick":
            return dialect.entry(LISTS[args[0]], f"({number} % {len(LISTS[args[0]])})")
        low, high = args[1:]
        return f"(CAST({int(low) * 100} + {number} % {(int(high) - int(low)) * 100} AS DOUBLE) / 100)"

    return re.sub(r"\{(\w+:[^}]+)\}", one, template)


@dataclass(frozen=True)
class Generator:
    """Columns by template over seed rows numbered ``i``; ``fan`` repeats a row with j from 1."""

    columns: dict[str, str]
    fan: str | None = None
    keep: str | None = None

    def rows(self, seeds: DataFrame, seed: int) -> DataFrame:
        df, i = seeds, "i"
        if self.fan:
            df = df.withColumn("j", F.explode(F.expr("filter(sequence(1L, greatest(1L, {0})), x -> x <= {0})".format(f"CAST({render(self.fan, SPARK, seed)} AS BIGINT)"))))
            df, i = df.withColumn("ij", F.col("i") * 1000 + F.col("j")), "ij"
        df = df.selectExpr(*(f"{render(t, SPARK, seed, i)} AS {c}" for c, t in self.columns.items()), *([f"{render(self.keep, SPARK, seed, i)} AS keep_"] if self.keep else []))
        return df.where("keep_").drop("keep_") if self.keep else df

    def sql(self, seeds: str, seed: int) -> str:
        i = "i"
        if self.fan:
            seeds, i = f"SELECT *, i * 1000 + j AS ij FROM (SELECT *, unnest(range(1, CAST({render(self.fan, DUCKDB, seed)} AS INT) + 1)) AS j FROM ({seeds}))", "ij"
        body = f"SELECT {', '.join(f'{render(t, DUCKDB, seed, i)} AS {c}' for c, t in self.columns.items())} FROM ({seeds})"
        return body + (f" WHERE {render(self.keep, DUCKDB, seed, i)}" if self.keep else "")


DATE = "CAST(DATE '2024-01-01' + CAST({n:%s:600} AS INT) AS VARCHAR(10))"
_CLAIM = {"claim_id": "{id:SYN-CLM-SCEN}", "member_id": "{id:SYN-MBR-SCEN}", "coverage_id": "{id:SYN-COV-SCEN}", "provider_id": "CAST({n:provider:100} AS VARCHAR(10))", "service_date": DATE % "service", "billed": "{money:billed:50:5000}", "status": "'paid'"}
SCENARIOS = {
    "scenario_normal_claims": Generator(_CLAIM),
    "scenario_high_cost_claims": Generator(_CLAIM | {"line_number": "j", "billed": "{money:billed:75000:350000}"}, fan="3 + {n:lines:6}"),
    "scenario_duplicate_claims": Generator(_CLAIM | {"claim_id": "'SYN-CLM-SCEN-' || CAST(i AS VARCHAR(20))", "copy": "j", "billed": "50.0", "service_date": "'2024-06-01'", "member_id": "'SYN-MBR-SCEN-' || CAST(i AS VARCHAR(20))", "coverage_id": "'SYN-COV-SCEN-' || CAST(i AS VARCHAR(20))", "provider_id": "'7'"}, fan="2"),
    "scenario_invalid_claim_references": Generator(_CLAIM | {"member_id": "{id:SYN-MBR-SCEN-NX}", "coverage_id": "{id:SYN-COV-SCEN-NX}"}),
    "scenario_expired_coverage": Generator(_CLAIM | {"term_date": "CAST(DATE '2023-06-30' + CAST({n:term:365} AS INT) AS VARCHAR(10))", "service_date": "CAST(DATE '2023-06-30' + CAST({n:term:365} AS INT) + CAST(1 + {n:after:60} AS INT) AS VARCHAR(10))"}),
    "scenario_missing_provider": Generator(_CLAIM | {"provider_id": "CASE WHEN i % 2 = 0 THEN NULL ELSE {id:SYN-PRV-SCEN-NX} END", "encounter_id": "{id:SYN-ENC-SCEN}"}),
    "scenario_unusual_prescription_combinations": Generator({"prescription_id": "'SYN-RX-SCEN-' || CAST(ij AS VARCHAR(20))", "member_id": "i", "drug_name": "CASE i % 3 " + " ".join(f"WHEN {k} THEN CASE j WHEN 1 THEN '{a}' ELSE '{b}' END" for k, (a, b) in enumerate(PAIRS)) + " END", "days_supply": "90", "refill_number": "CASE j WHEN 1 THEN 0 ELSE 8 END", "fill_date": "'2024-03-01'"}, fan="2"),
    "scenario_missing_laboratory_values": Generator({"lab_result_id": "{id:SYN-LAB-SCEN}", "collected_date": DATE % "collected", "result_value": "CAST(NULL AS VARCHAR(10))", "resulted_date": "CAST(NULL AS VARCHAR(10))"}),
    "scenario_boundary_dates": Generator({"claim_id": "'SYN-CLM-SCEN-' || CAST(ij AS VARCHAR(20))", "service_date": "CASE j WHEN 1 THEN '2024-02-29' WHEN 2 THEN '2024-12-31' WHEN 3 THEN '2025-01-01' ELSE '2024-06-01' END", "same_day": "j = 4"}, fan="4"),
    "scenario_null_heavy_records": Generator({"member_id": "{id:SYN-MBR-SCEN}", "gender": "CAST(NULL AS VARCHAR(1))", "phone": "CAST(NULL AS VARCHAR(10))", "email": "CAST(NULL AS VARCHAR(10))"}),
    "scenario_very_large_claim_histories": Generator({"claim_id": "'SYN-CLM-SCEN-' || CAST(ij AS VARCHAR(20))", "member_id": "i", "service_date": "CAST(DATE '2020-01-01' + CAST(j * 7 AS INT) AS VARCHAR(10))", "billed": "{money:billed:50:5000}"}, fan="250"),
}


def claim_with_lines(claims: DataFrame, seed: int) -> DataFrame:
    """Allowed 50-90 % of billed, paid 60-100 % of allowed and null when denied, the charge split over the lines."""
    u = lambda tag: render(f"{{u:{tag}}}", SPARK, seed)
    cents = lambda e: f"floor(({e}) * 100 + 0.5) / 100"
    priced = claims.selectExpr("*", f"{cents(f'billed * (0.5 + 0.4 * {u("allowed")})')} AS allowed")
    priced = priced.selectExpr("*", f"CASE WHEN status <> 'denied' THEN {cents(f'allowed * (0.6 + 0.4 * {u("paid")})')} END AS paid")
    return priced.withColumn("line_number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_lines").cast("long")))).withColumn("charge", F.expr(cents("billed / n_lines")))


def tag(df: DataFrame, provenance: str, batch: str, scenario: str | None = None) -> DataFrame:
    cols = {"data_provenance": F.lit(provenance), "synthetic_batch_id": F.lit(batch)}
    return df.withColumns(cols | ({"scenario_type": F.lit(scenario)} if scenario else {}))


def tag_base(df: DataFrame, batch: str, provenance: str = "masked_production_like") -> DataFrame:
    """Untagged rows get the base's tag; tagged ones keep theirs."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    own = have("data_provenance").isNull()
    return df.withColumns({"synthetic_batch_id": F.when(own, F.lit(batch)).otherwise(have("synthetic_batch_id")), "data_provenance": F.coalesce(have("data_provenance"), F.lit(provenance))})


def merge(base: DataFrame, new: DataFrame, batch: str | None = None) -> DataFrame:
    """Rows of both with the union of their columns; new rows may get a batch of their own."""
    return base.unionByName(new.withColumn("batch", F.lit(batch)) if batch else new, allowMissingColumns=True)


def provenance_counts(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select("data_provenance")
    for f in frames[1:]:
        out = out.unionByName(f.select("data_provenance"))
    return out.where("data_provenance IS NOT NULL").groupBy("data_provenance").agg(F.count("*").alias("n"))
