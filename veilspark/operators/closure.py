"""Referential closure: every row that the selected members reach, by semi joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hop:
    """One step: rows of ``entity`` whose ``key`` is among the ``keys`` of ``sources``."""

    name: str
    entity: str
    key: str
    sources: tuple[tuple[str, str], ...]


HOPS = [
    Hop("member", "member", "member_id", (("anchor", "member_id"),)),
    Hop("demographics", "member_demographics", "member_id", (("member", "member_id"),)),
    Hop("address", "address", "member_id", (("member", "member_id"),)),
    Hop("coverage", "coverage", "member_id", (("member", "member_id"),)),
    Hop("plan", "plan", "plan_id", (("coverage", "plan_id"),)),
    Hop("claim", "claim", "member_id", (("member", "member_id"),)),
    Hop("claim_line", "claim_line", "claim_id", (("claim", "claim_id"),)),
    Hop("codes", "code", "code", (("claim_line", "code"),)),
    Hop("prescription", "prescription", "member_id", (("member", "member_id"),)),
    Hop("pharmacy", "pharmacy", "pharmacy_id", (("prescription", "pharmacy_id"),)),
    Hop("encounter", "encounter", "member_id", (("member", "member_id"),)),
    Hop("lab_ehr", "lab_ehr", "member_id", (("member", "member_id"),)),
    Hop("lab_partner_v1", "lab_partner_v1", "pat_id", (("member", "member_id"),)),
    Hop("lab_partner_v2", "lab_partner_v2", "member_id", (("member", "member_id"),)),
    Hop("provider", "provider", "provider_id", (("claim", "provider_id"), ("encounter", "provider_id"), ("prescription", "prescriber_id"))),
]
#: Relationship -> (child, foreign key, parent, primary key), as the integrity check takes them.
RELATIONSHIPS = {
    "coverage.plan_id": ("coverage", "plan_id", "plan", "plan_id"),
    "claim.member_id": ("claim", "member_id", "member", "member_id"),
    "claim.provider_id": ("claim", "provider_id", "provider", "provider_id"),
    "claim_line.claim_id": ("claim_line", "claim_id", "claim", "claim_id"),
    "claim_line.code": ("claim_line", "code", "code", "code"),
    "prescription.pharmacy_id": ("prescription", "pharmacy_id", "pharmacy", "pharmacy_id"),
    "prescription.prescriber_id": ("prescription", "prescriber_id", "provider", "provider_id"),
    "encounter.provider_id": ("encounter", "provider_id", "provider", "provider_id"),
}


def keys_of(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).where(F.col(name).isNotNull())


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values as strings."""
    return df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()


#: Columns that name the rows of their hop, so that they repeat little and need no shuffle to be distinct.
NAMING = {("anchor", "member_id"), ("member", "member_id"), ("claim", "claim_id")}


def key_union(frames: dict[str, DataFrame], sources: tuple[tuple[str, str], ...], name: str) -> DataFrame:
    """The keys that a hop follows, for a semi join; those that repeat much once each."""
    keys = reduce(DataFrame.unionByName, [keys_of(frames[s], c, name) for s, c in sources])
    return keys if set(sources) <= NAMING else keys.distinct()


#: Hops whose rows later hops or several checks read.
PARENTS = {s for h in HOPS for s, _ in h.sources}


def closure(estate: dict[str, DataFrame], anchors: DataFrame, only: str | None = None, write: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Entity -> selected rows, in hop order.

    Semi joins keep repeated rows as they are.  With ``write`` the rows of a hop that
    others build on are written once and read from there; without it nothing runs.
    """
    frames = {"anchor": anchors}
    for hop in HOPS:
        keys = key_union(frames, hop.sources, hop.key)
        rows = estate[hop.entity].join(keys, hop.key, "left_semi")
        frames[hop.name] = frames[hop.entity] = write(rows, hop.name) if write and hop.name in PARENTS else rows
        if hop.name == only:
            break
    return frames


def edges(frames: dict[str, DataFrame]) -> DataFrame:
    """parent, child, n: rows that each hop selected."""
    parts = [frames[h.name].agg(F.count("*").alias("n")).select(F.lit(h.sources[0][0]).alias("parent"), F.lit(h.name).alias("child"), "n") for h in HOPS]
    return reduce(DataFrame.unionByName, parts)


def dangling(frames: dict[str, DataFrame], estate: dict[str, DataFrame]) -> DataFrame:
    """relationship, id, category: referenced ids that the selection lacks.

    engine_bug: the source has the parent, so the closure lost it; source_orphan: the
    source lacks it too.
    """
    parts = []
    for name, (child, fk, parent, pk) in RELATIONSHIPS.items():
        refs = keys_of(frames[child], fk, "id").distinct()
        missing = refs.join(keys_of(frames[parent], pk, "id"), "id", "left_anti")
        there = keys_of(estate[parent], pk, "id").distinct().withColumn("found", F.lit(True))
        parts.append(missing.join(there, "id", "left").select(F.lit(name).alias("relationship"), F.col("id").cast("long").alias("id"), F.when(F.col("found"), "engine_bug").otherwise("source_orphan").alias("category")))
    return reduce(DataFrame.unionByName, parts)


def dangling_tally(found: DataFrame) -> DataFrame:
    return found.groupBy("relationship").agg(F.count_if(F.col("category") == "engine_bug").alias("engine_bug"), F.count_if(F.col("category") == "source_orphan").alias("source_orphan"))


def verdict(found: DataFrame, injected: DataFrame | None = None) -> DataFrame:
    """One row: engine bugs, source orphans, injected orphans and the verdict."""
    if injected is not None:
        found = found.unionByName(injected)
    sums = found.agg(*(F.count_if(F.col("category") == c).alias(c) for c in ("engine_bug", "source_orphan", "negative_test")))
    return sums.withColumn("verdict", F.when(F.col("engine_bug") > 0, "failed").when(F.col("source_orphan") + F.col("negative_test") > 0, "passed_with_known_orphans").otherwise("passed"))


def inject_orphans(frames: dict[str, DataFrame], count: int) -> tuple[DataFrame, DataFrame]:
    """(providers without ``count`` still referenced ones, one dangling row for each broken claim)."""
    used = frames["provider"].join(keys_of(frames["claim"], "provider_id", "provider_id").distinct(), "provider_id", "left_semi")
    gone = used.select("provider_id").distinct().orderBy("provider_id").limit(count)
    broken = frames["claim"].join(gone, "provider_id", "left_semi").select(F.lit("claim.provider_id").alias("relationship"), F.col("claim_id").alias("id"), F.lit("negative_test").alias("category"))
    return frames["provider"].join(gone, "provider_id", "left_anti"), broken


def row_counts(frames: dict[str, DataFrame], entities: dict[str, list[str]]) -> DataFrame:
    """entity, n: rows of each logical entity, which may have several frames."""
    parts = [frames[f].agg(F.count("*").alias("n")).select(F.lit(entity).alias("entity"), "n") for entity, names in entities.items() for f in names]
    return reduce(DataFrame.unionByName, parts).groupBy("entity").agg(F.sum("n").alias("n"))
