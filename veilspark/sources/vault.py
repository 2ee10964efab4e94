"""A durable vault of tokens: every value has one token, no two values share one.

Two tables of snapshots hold it, one by value and one by token, so that a run reads and
rewrites only the partitions of its new values and of the tokens that it tries.  A token
is a keyed digest of value and attempt: a task that runs again gives the same tokens.  A
token that another value has is tried anew with the next attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import hmac_hex, hmac_hex_hidden
from . import pointer
from .shared import stash
from .snapshots import SnapshotTable


class TokenVault:
    """The vault below ``root``; ``digits`` hex digits after the prefix, so 16 ** digits tokens at most."""

    def __init__(self, spark: SparkSession, root: str, key: bytes, digits: int = 12, buckets: int = 64, hidden: bool = True, prefix: str = "TKN-"):
        if not 1 <= digits <= 64:
            raise ValueError("a token has 1 to 64 digits")
        self.spark, self.key, self.digits, self.prefix = spark, key, digits, prefix
        self.digest = hmac_hex_hidden if hidden else hmac_hex
        self.by_value, self.by_token = (self._table(f"{root.rstrip('/')}/{n}", n, buckets) for n in ("value", "token"))

    def _table(self, root: str, key: str, buckets: int) -> SnapshotTable:
        if pointer.read(self.spark, root) is None:
            return SnapshotTable.create(self.spark, root, self.spark.createDataFrame([], "value string, token string"), key, buckets)
        return SnapshotTable(self.spark, root)

    def token(self, attempt: int) -> Column:
        return F.concat(F.lit(self.prefix), F.upper(F.substring(self.digest(F.col("value"), f"vault-{attempt}", self.key), 1, self.digits)))

    def extend(self, values: DataFrame) -> int:
        """Give every value of the column ``value`` a token, and say how many are new; null has none.

        Of new values that meet on one token the least takes it.  Tokens are reserved
        before values are entered, so a run that was stopped in between is finished by
        the next one.
        """
        asked = stash(values.select(F.col("value").cast("string").alias("value")).where("value IS NOT NULL").distinct(), "vault-asked")
        left = stash(asked.join(self.by_value.near(asked).select("value"), "value", "left_anti"), "vault-new")
        new, attempt, most = left.count(), 0, 64 * 16 ** min(self.digits, 3)
        while not left.isEmpty():
            if attempt > most:
                raise RuntimeError(f"{16**self.digits} tokens are too few")
            tried = stash(left.withColumn("token", self.token(attempt)), "vault-tried")
            used = self.by_token.near(tried, "token").select("token", F.col("value").alias("owner"))
            free = tried.join(used, "token", "left").where("owner IS NULL OR owner = value")
            won = stash(free.groupBy("token").agg(F.min("value").alias("value")).select("value", "token"), "vault-won")
            self.by_token.apply(won, f"attempt {attempt}", insert=True)
            self.by_value.apply(won, f"attempt {attempt}", insert=True)
            left = stash(left.join(won, "value", "left_anti"), "vault-left")
            attempt += 1
        return new

    def tokens(self, values: DataFrame) -> DataFrame:
        """value and token of the values that the vault knows."""
        asked = values.select(F.col("value").cast("string").alias("value")).distinct()
        return asked.join(self.by_value.near(asked), "value")

    def values(self, tokens: DataFrame) -> DataFrame:
        """token and value of the tokens that the vault has given."""
        asked = tokens.select("token").distinct()
        return asked.join(self.by_token.near(asked), "token")
