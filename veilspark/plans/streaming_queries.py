"""Batch and stream forms over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masking as M
from ..sources.shared import folder
from ..streaming import arrivals as A
from ..streaming import streams as S
from .base import WITH, query, table
from .masking_queries import MASKER, SCOPE, token_sql


@query("replayed_claims", f"{WITH} SELECT claim_id, member_id FROM claim")
def replayed_claims(spark, sf_dir):
    """Claims of which some arrive twice, once each."""
    claims = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS claim_id", "o_custkey AS member_id")
    return claims.unionByName(claims.where("claim_id % 7 = 0")).dropDuplicates(["claim_id"])


@query("late_arriving", "SELECT event_id, event_id % 120 > 90 AS late FROM events")
def late_arriving(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("happened"))
    return S.mark_late(events.withColumn("delivered", F.date_add("happened", (F.col("event_id") % 120).cast("int"))), "delivered", "happened").select("event_id", "late")


def _stream(spark, sf_dir, transform, name):
    """The event table as the input folder of a stream."""
    events = table(spark, sf_dir, "events")
    source = folder(spark, f"{name}-in")
    events.write.parquet(source)
    return S.run_once(spark, source, events.schema, transform, folder(spark, f"{name}-out"), folder(spark, f"{name}-state"))


@query("stream_replays", "SELECT event_id, user_id FROM events")
def stream_replays(spark, sf_dir):
    def transform(stream):
        twice = stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
        return S.collapse_replays(twice, "event_id", "ts").select("event_id", "user_id")

    return _stream(spark, sf_dir, transform, "replays")


@query("stream_masking", f"SELECT event_id, {token_sql('user_id', SCOPE)} AS member FROM events")
def stream_masking(spark, sf_dir):
    """The batch masking expressions, unchanged, on a stream."""
    return _stream(spark, sf_dir, lambda s: s.select("event_id", M.token(MASKER.digest(F.col("user_id"), SCOPE)).alias("member")), "masking")


#: Three deliveries of member records: all; some again and some changed; some again after the state's time limit, and some changed once more.
_DELIVERIES = [("2024-01-01", "true", "c_mktsegment"), ("2024-01-20", "c_custkey % 7 = 0 OR c_custkey % 5 = 0", "CASE WHEN c_custkey % 5 = 0 THEN 'moved' ELSE c_mktsegment END"), ("2025-01-01", "c_custkey % 3 = 0", "CASE WHEN c_custkey % 30 = 0 THEN 'left' WHEN c_custkey % 5 = 0 THEN 'moved' ELSE c_mktsegment END")]
_ARRIVED = " UNION ALL ".join(f"SELECT c_custkey AS member_id, {segment} AS segment, TIMESTAMP '{day} 00:00:00' AS delivered FROM customer WHERE {where}" for day, where, segment in _DELIVERIES)


@query("stream_versions", f"WITH arrived AS ({_ARRIVED}), changed AS (SELECT *, lag(segment) OVER (PARTITION BY member_id ORDER BY delivered) AS was FROM arrived) SELECT member_id, arg_max(segment, delivered) AS segment, max(delivered) AS since FROM changed WHERE was IS DISTINCT FROM segment GROUP BY member_id")
def stream_versions(spark, sf_dir):
    """The newest contents of every member and since when, after three micro-batches with replays and new versions."""
    customer = table(spark, sf_dir, "customer")
    source, state = folder(spark, "arrivals-in"), folder(spark, "arrivals-state")
    kept = None
    for day, where, segment in _DELIVERIES:
        rows = customer.where(where).select(F.col("c_custkey").alias("member_id"), F.expr(segment).alias("segment"), F.lit(f"{day} 00:00:00").cast("timestamp").alias("delivered"))
        rows.write.mode("append").parquet(source)
        kept = kept or A.sink(spark, folder(spark, "arrivals-table"), rows.schema, "member_id", 16)
        A.run(spark, source, rows.schema, "member_id", ["member_id", "segment"], "delivered", kept, state, files=10_000)
    return kept.rows().select("member_id", "segment", F.col("delivered").alias("since"))
