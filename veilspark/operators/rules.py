"""Rules over columns as joins: field types, linkage scopes, masking rules, detectors and the catalog.

A column is a row (entity, column_name, more).  Rule tables are fixed and small, so each
is broadcast; where several rules match, the first one or the surest one wins by
``min_by``.  Every function keeps the columns it is given and adds its own; a null
column name matches no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import policy as P
from . import profile as D

KEYS = ["entity", "column_name"]


def rule_table(columns: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(columns.sparkSession.createDataFrame(rows, schema))  # a fixed list


def first_match(columns: DataFrame, rules: DataFrame, best: Column, value: str, named: str) -> DataFrame:
    """``value`` of the rule that matches the column's name and has the least ``best``, as ``named``; null without a match."""
    hits = columns.select(*KEYS).join(rules, F.expr("regexp_like(lower(column_name), pattern)"))
    found = hits.groupBy(*KEYS).agg(F.min_by(F.expr(value), best).alias(named))
    return columns.join(found, KEYS, "left")


def field_types(columns: DataFrame) -> DataFrame:
    """field_type: of the first pattern that the name matches, else generic."""
    rules = rule_table(columns, [(i, k, p) for i, (k, p) in enumerate(P.FIELD_TYPES)], "number int, kind string, pattern string")
    return first_match(columns, rules, F.col("number"), "kind", "__kind").withColumn("field_type", F.coalesce("__kind", F.lit("generic"))).drop("__kind")


def linkage_scopes(columns: DataFrame) -> DataFrame:
    """linkage_scope: shared by the aliases of one identifier, in any case; else null."""
    aliases = rule_table(columns, [(a, s) for s, names in P.SCOPES.items() for a in names], "__alias string, linkage_scope string")
    return columns.join(aliases, F.lower("column_name") == F.col("__alias"), "left").drop("__alias")


def resolve(columns: DataFrame) -> DataFrame:
    """technique, field_type and scope of every column by its tier; one without a tier is pseudonymised under a scope of its own."""
    known = linkage_scopes(field_types(columns))
    rules = rule_table(columns, [(i, t, k, p) for i, (p, t, k) in enumerate(P.FIELD_RULES)], "number int, technique string, kind string, pattern string")
    known = first_match(known, rules, F.col("number"), "struct(technique, kind)", "__rule")
    tiers = rule_table(columns, [(k, *v) for k, v in P.FALLBACK.items()], "tier string, __technique string, __scope string")
    known = known.join(tiers, "tier", "left")
    missing, passed, linked = F.col("tier").isNull(), F.col("__technique") == "passthrough", F.col("linkage_scope").isNotNull()
    technique = F.when(missing, "hmac_pseudonymization").when(passed, F.col("__technique")).when(linked, "tokenization").otherwise(F.coalesce("__rule.technique", "__technique"))
    kind = F.when(missing | passed, F.col("field_type")).when(linked, "identifier").otherwise(F.coalesce(F.nullif(F.col("__rule.kind"), F.lit("generic")), F.col("field_type")))
    scope = F.when(missing, F.concat(F.lit("unclassified:"), "column_name")).when(~passed & linked, F.col("linkage_scope")).otherwise(F.col("__scope"))
    return known.withColumns({"technique": technique, "field_type": kind, "scope": scope}).drop("linkage_scope", "__rule", "__technique", "__scope")


def detect(columns: DataFrame, name: Column | None = None) -> DataFrame:
    """entity, column_name, detector, category, confidence: every detector whose name pattern fires; NPIs of providers and pharmacies are surer."""
    rules = rule_table(columns, [(i, d, c, x, p) for i, (d, c, x, p, _) in enumerate(D.DETECTORS)], "number int, detector string, category string, confidence double, pattern string")
    asked = columns.select(*KEYS, F.lower(F.col("column_name") if name is None else name).alias("__name"))
    hits = asked.join(rules, F.expr("regexp_like(__name, pattern)"))
    sure = (F.col("detector") == "npi") & F.lower(F.trim("entity")).isin(*D.NPI_ENTITIES)
    return hits.select(*KEYS, "number", "detector", "category", F.when(sure, D.NPI_BOOST).otherwise(F.col("confidence")).alias("confidence"))


def classify(columns: DataFrame, rules: DataFrame, overrides: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """category, confidence, layer, reason and confirmed_by: override, else schema rule, else the surest detector, else the cautious default.

    ``rules`` are (entity, column_name, category), ``overrides`` too, both one row a
    column and with reason where they have one; overrides may go by source as well, and
    say who confirmed them.  ``values`` are further detections by what columns hold, as
    ``detect`` returns them.
    """
    hits = detect(columns) if values is None else detect(columns).unionByName(values)
    best = hits.groupBy(*KEYS).agg(F.min_by(F.struct("category", "confidence", "detector"), F.struct(-F.col("confidence"), F.col("number"))).alias("__best"))
    known = columns.join(best, KEYS, "left")
    text = lambda frame, c: (F.col(c) if c in frame.columns else F.lit(None)).cast("string")
    for frame, own in ((rules, "__rule"), (overrides, "__override")):
        by = [*KEYS, *(["source"] if "source" in frame.columns else [])]
        known = known.join(frame.select(*by, F.struct("category", text(frame, "reason").alias("reason"), text(frame, "confirmed_by").alias("confirmed_by")).alias(own)), by, "left")
    given = F.coalesce("__override", "__rule")
    return known.withColumns({
        "category": F.coalesce(given["category"], F.col("__best.category"), F.lit(D.DEFAULT[0])),
        "confidence": F.when(given.isNotNull(), 1.0).otherwise(F.coalesce("__best.confidence", F.lit(D.DEFAULT[1]))),
        "layer": F.when(F.col("__override").isNotNull(), "override").when(F.col("__rule").isNotNull(), "schema").when(F.col("__best").isNotNull(), "pattern").otherwise("default"),
        "reason": F.coalesce(given["reason"], F.concat(F.lit("detector "), F.col("__best.detector")), F.when(given.isNull(), "no rule and no detector")),
        "confirmed_by": F.col("__override.confirmed_by"),
    }).drop("__best", "__rule", "__override")


def catalog(classified: DataFrame, owners: DataFrame) -> DataFrame:
    """tier, strategy, owner and retention of classified columns; ``owners`` is (source, owner)."""
    tiers = rule_table(classified, [(c, t, D.STRATEGY[t], D.RETENTION[c]) for c, t in D.TIER.items()], "category string, tier string, strategy string, __retention string")
    named = classified.join(tiers, "category", "left").join(owners, "source", "left")
    return named.withColumn("retention", F.when(F.col("entity").isin(*D.REFERENCE, *D.CODE_TABLES), "persistent_reference").otherwise(F.col("__retention"))).drop("__retention")


def look_up(columns: DataFrame, catalogued: DataFrame) -> DataFrame:
    """Columns with the tier that the catalog (entity, column_name, tier) has for them, and the rule that follows; a miss has no tier."""
    return resolve(columns.join(catalogued.select(*KEYS, "tier"), KEYS, "left"))
