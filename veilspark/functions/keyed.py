"""Keyed hashing and hash-ordered picks as column expressions."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above this many rows a pick is made by hash buckets instead of one sorted limit.
SORTED_PICK = 100_000
_BUCKETS = 4096


def _pads(key: bytes) -> tuple[str, str]:
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_hex(value: Column, scope: str, key: bytes) -> Column:
    """Hex HMAC-SHA256(key, "scope:value"), JVM-side; null stays null.

    The key's pads are literals of the plan, so this form is for keys that the plan may
    show; ``hmac_hex_hidden`` keeps a secret key out of it.
    """
    inner, outer = _pads(key)
    message = F.encode(F.concat(F.lit(f"{scope}:"), value.cast("string")), "UTF-8")
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), message), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer)), first), 256)


def hmac_hex_hidden(value: Column, scope: str, key: bytes) -> Column:
    """The same digest by an Arrow UDF, whose closure hides the key from plan and event log."""
    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(key, f"{scope}:{v}".encode(), "sha256").hexdigest())

    return digest(value.cast("string"))


def hmac_sql(value: str, scope: str, key: bytes) -> str:
    """The digest in DuckDB's SQL."""
    inner, outer = _pads(key)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('{scope}:' || CAST({value} AS VARCHAR)))))"


def number(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits from position ``start`` (from 1) as a long."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def number_sql(digest: str, start: int, digits: int) -> str:
    return f"CAST('0x' || substr({digest}, {start}, {digits}) AS BIGINT)"


def pick_order(seed: int | str, *ids: str) -> Column:
    """Hex digest by which seeded picks are ordered."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def pick_order_sql(seed: int | str, *ids: str) -> str:
    return "md5(" + " || ':' || ".join([f"'{seed}'", *(f"CAST({i} AS VARCHAR)" for i in ids)]) + ")"


def pick(df: DataFrame, key: str, k: int, seed: int | str) -> DataFrame:
    """Exactly min(k, rows) rows of ``df``, by hash order; ties by key.

    A large pick counts rows by hash bucket, takes whole buckets and sorts only the
    one at the edge, so no task sorts the pick.
    """
    order = pick_order(seed, key)
    if k <= SORTED_PICK:
        return df.orderBy(order, key).limit(k)
    marked = df.withColumn("__bucket", number(order, 1, 3))
    taken, edge = 0, _BUCKETS
    for row in marked.groupBy("__bucket").count().orderBy("__bucket").collect():
        if taken + row["count"] > k:
            edge = row["__bucket"]
            break
        taken += row["count"]
    whole = marked.where(F.col("__bucket") < edge)
    rest = marked.where(F.col("__bucket") == edge).orderBy(order, key).limit(k - taken)
    return whole.unionByName(rest).drop("__bucket")
