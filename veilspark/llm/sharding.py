"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by a key: the hash of the text, then the hash of the id, so equal
texts stand together and a group of any size can still be cut.  Keys are sampled with
a chance in proportion to the record's size; the sample's quantiles bound a few
hundred ranges; ranges that turn out overfull are subdivided by splitters sampled
inside them; and consecutive ranges are dealt to the shards by their exact bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SHARDS = 8
#: Ranges aimed at, sampled keys for each range, rounds of subdividing.
RANGES, KEYS_PER_RANGE, ROUNDS = 512, 32, 3
#: A range is overfull above this many times the mean.
OVERFULL = 2.0


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key of every record."""
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    group, own = F.xxhash64(text), F.xxhash64(F.col("doc_id").cast("string"), F.lit(1))
    key = group.bitwiseAND(F.lit(~0xFFFFF)).bitwiseOR(own.bitwiseAND(F.lit(0xFFFFF)))
    return docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), key.alias("key"))


def sample_keys(rows: DataFrame, rate: float, salt: int) -> list[int]:
    """Keys drawn with chance size * rate; about as many as the caller asks for."""
    chance = F.pmod(F.xxhash64("doc_id", "key", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    return sorted(r.key for r in rows.where(chance < F.col("size") * F.lit(rate)).select("key").collect())


def literals(numbers: list[int]) -> Column:
    """A constant array of longs: a few hundred, by RANGES."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def range_of(splitters: list[int]) -> Column:
    """Splitters at or below the key, found by halving."""
    steps = max(1, len(splitters).bit_length())
    padded = literals([*splitters, *[(1 << 63) - 1] * ((1 << steps) - len(splitters))])

    widths = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(widths, F.lit(0), lambda at, w: at + F.when(F.get(padded, at + w - 1) <= F.col("key"), w).otherwise(0))


def split(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard).

    A null text counts one byte.  Repeated rows keep their copies and get slots of
    their own; null ids are records like others; an empty table gives no rows.
    """
    rows = cut(records(docs))
    total = rows.agg(F.sum("size").alias("size")).first().size or 0
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    drawn = sample_keys(rows, RANGES * KEYS_PER_RANGE / total, 0)
    splitters = sorted({drawn[i * len(drawn) // RANGES] for i in range(1, RANGES)} if drawn else set())
    for again in range(ROUNDS + 1):
        placed = rows.withColumn("range", range_of(splitters))
        stats = placed.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        full = [s for s in stats if s["size"] > OVERFULL * total / RANGES and s["low"] < s["high"]]
        if not full or again == ROUNDS:
            break
        inside = sum(s["size"] for s in full)
        wanted = KEYS_PER_RANGE * sum(2 + int(s["size"] * RANGES / total) for s in full)
        drawn = sample_keys(placed.where(F.col("range").isin([s["range"] for s in full])), wanted / inside, again + 1)
        for s in full:
            own = [k for k in drawn if s["low"] <= k <= s["high"]]
            parts = 2 + int(s["size"] * RANGES / total)
            splitters += [own[i * len(own) // parts] for i in range(1, parts) if own]
        splitters = sorted(set(splitters))
    before, taken = 0, [0] * shards
    shard_of, first_of = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1)
    for s in sorted(stats, key=lambda s: s["range"]):
        shard = min(shards - 1, int((before + s["size"] / 2) * shards / total))
        shard_of[s["range"]], first_of[s["range"]] = shard, taken[shard]
        taken[shard] += s["n"]
        before += s["size"]
    slot = F.row_number().over(Window.partitionBy("range").orderBy("key", "doc_id")) - 1
    dealt = placed.select("*", slot.alias("slot"), F.get(literals(shard_of), F.col("range")).cast("int").alias("shard"), F.get(literals(first_of), F.col("range")).alias("first"))
    return dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("first")).cast("long").alias("slot"))
