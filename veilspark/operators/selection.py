"""The six ways to select members, each a frame of distinct member ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keyed import pick, pick_order

#: Values that mark a malformed field (fixed values).
BAD_DISCHARGE, BAD_ZIP = ("TBD", "UNKNOWN", ""), ("00000", "ABCDE", "")


def percentage_sample(members: DataFrame, key: str, percentage: float, seed: int) -> DataFrame:
    """Exactly max(1, half-even round of n * percentage / 100) members."""
    if not 0 < percentage <= 100:
        raise ValueError("percentage must be in (0, 100]")
    n = members.count()
    return pick(members.select(key), key, max(1, round(n * percentage / 100)) if n else 0, seed)


def fixed_population(members: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """Exactly min(count, available) members."""
    return pick(members.select(key), key, count, seed)


def strata(members: DataFrame, demographics: DataFrame, key: str, field: str, other: str) -> DataFrame:
    """key, stratum: the member's field, else the demographics', else the text None."""
    found = demographics.select(F.col(key).alias("__key"), F.col(other).alias("__other"))
    joined = members.select(key, F.col(field).alias("__own")).join(found, F.col(key) == F.col("__key"), "left")
    return joined.select(key, F.coalesce("__own", "__other", F.lit("None")).alias("stratum"))


def stratified_sample(strata: DataFrame, key: str, per_stratum: int, seed: int) -> DataFrame:
    """Up to ``per_stratum`` members of every stratum, by hash order."""
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(pick_order(seed, key), key))
    return strata.withColumn("__place", place).where(F.col("__place") <= per_stratum).drop("__place")


def date_window(claims: DataFrame, key: str, date_text: str, start: str, end: str) -> DataFrame:
    """Members with a claim whose first ten characters lie in the window."""
    if start > end:
        raise ValueError("the window starts after its end")
    return claims.where(F.substring(date_text, 1, 10).between(start, end)).select(key).distinct()


def claims_per_member(claims: DataFrame, key: str, status: str, least: int) -> DataFrame:
    return claims.where(F.col("status") == status).groupBy(key).agg(F.count("*").alias("n_claims")).where(F.col("n_claims") >= least)


def business_rule(coverage: DataFrame, claims: DataFrame, key: str, coverage_status: str = "active", claim_status: str = "paid", least: int = 1) -> DataFrame:
    """Members with a coverage in one status and enough claims in another."""
    covered = coverage.where(F.col("status") == coverage_status).select(key)
    return claims_per_member(claims, key, claim_status, least).select(key).join(covered, key, "left_semi")


def malformed_discharge() -> Column:
    return F.col("discharge_date").isin(*BAD_DISCHARGE)


def malformed_zip() -> Column:
    return F.col("zip").isin(*BAD_ZIP)


def without(members: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return members.select(key).join(rows.select(key), key, "left_anti")


def members_of_lines(lines: DataFrame, claims: DataFrame, wanted: Column) -> DataFrame:
    """Members whose claims hold a line that meets the condition."""
    ids = lines.where(wanted).select("claim_id").distinct()
    return claims.join(ids, "claim_id", "left_semi").select("member_id").distinct()


def risk_signals(e: dict[str, DataFrame], unmapped: Column, orphan_provider: Column) -> DataFrame:
    """signal, member_id: one row for each member and edge case it shows."""
    marked = lambda name, df: df.select(F.lit(name).alias("signal"), F.col("member_id"))
    parts = [
        marked("negative_amount", e["claim"].where("billed < 0")),
        marked("unmapped_code", members_of_lines(e["claim_line"], e["claim"], unmapped)),
        marked("orphan_provider", e["claim"].where(orphan_provider)),
        marked("malformed_discharge", e["encounter"].where(malformed_discharge())),
        marked("malformed_zip", e["address"].where(malformed_zip())),
        marked("negative_quantity", e["prescription"].where(F.col("quantity").cast("double") < 0)),
        marked("no_coverage", without(e["member"], e["coverage"], "member_id")),
        marked("terminated", e["coverage"].where("status = 'terminated'")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(e["member"].select("member_id"), "member_id", "left_semi").distinct()
