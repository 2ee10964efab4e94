"""Tables of snapshots: a job rewrites the partitions that it changes and shares all others with the snapshot before.

Rows lie in partitions by a hash of their key.  A snapshot is a small manifest that
names the folder of every partition; the manifest in force is named by one pointer file
that is swapped by a rename.  A reader has the old snapshot or the new one, whatever a
writer does meanwhile, and a writer that was overtaken fails instead of losing changes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from . import pointer

BUCKET = "__bucket"


@dataclass(frozen=True)
class Snapshot:
    """number from 1, the job that made it, the manifest before it, and the folder of every partition that has rows."""

    number: int
    job: str
    before: str | None
    schema: str
    key: str
    buckets: int
    parts: dict[int, str]
    rewritten: tuple[int, ...]

    def to_json(self) -> str:
        return json.dumps({**self.__dict__, "parts": {str(k): v for k, v in self.parts.items()}, "rewritten": list(self.rewritten)})

    @staticmethod
    def of_json(text: str) -> Snapshot:
        d = json.loads(text)
        return Snapshot(**(d | {"parts": {int(k): v for k, v in d["parts"].items()}, "rewritten": tuple(d["rewritten"])}))


class SnapshotTable:
    """A table below ``root``.  Keys are unique; a null key is a key like others."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def create(spark: SparkSession, root: str, rows: DataFrame, key: str, buckets: int = 64, job: str = "create") -> SnapshotTable:
        table = SnapshotTable(spark, root)
        first = Snapshot(1, job, None, rows.schema.json(), key, buckets, {}, ())
        parts = table._write(rows, first)
        table._commit(replace(first, parts=parts, rewritten=tuple(sorted(parts))), None)
        return table

    def _bucket(self, s: Snapshot, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key or s.key}`").cast("string"), F.lit(""))), F.lit(s.buckets)).cast("int")

    def _write(self, rows: DataFrame, s: Snapshot) -> dict[int, str]:
        """The folders of the partitions that the rows fill; the rebalance lets Spark split a large one among tasks."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self._bucket(s)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
        found = pointer.children(self.spark, folder)
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in found if n.startswith(f"{BUCKET}=")}

    def _commit(self, s: Snapshot, before: str | None) -> None:
        path = f"{self.root}/manifests/{s.number:08d}-{uuid.uuid4().hex}.json"
        pointer.write_text(self.spark, path, s.to_json())
        pointer.swap(self.spark, self.root, path, expected=before)

    def current(self) -> tuple[str, Snapshot]:
        """The path of the manifest in force, and what it says."""
        path = pointer.read(self.spark, self.root)
        if path is None:
            raise FileNotFoundError(f"no snapshot below {self.root}")
        return path, Snapshot.of_json(pointer.read_text(self.spark, path))

    def history(self) -> list[Snapshot]:
        """All snapshots, the newest first."""
        path, s = self.current()
        out = [s]
        while s.before:
            s = Snapshot.of_json(pointer.read_text(self.spark, s.before))
            out.append(s)
        return out

    def _numbered(self, number: int) -> Snapshot:
        for s in self.history():
            if s.number == number:
                return s
        raise ValueError(f"no snapshot {number} below {self.root}")

    def rows(self, number: int | None = None, buckets: set[int] | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """The rows of the current snapshot, of one by number, or of some of its partitions."""
        s = snapshot or (self.current()[1] if number is None else self._numbered(number))
        schema = StructType.fromJson(json.loads(s.schema))
        paths = [p for k, p in sorted(s.parts.items()) if buckets is None or k in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def near(self, keys: DataFrame, column: str | None = None) -> DataFrame:
        """The rows of the partitions in which the keys of a frame lie; no other partition is read."""
        s = self.current()[1]
        touched = {r[0] for r in keys.select(self._bucket(s, column or s.key).alias(BUCKET)).distinct().collect()}  # at most ``buckets`` numbers
        return self.rows(buckets=touched, snapshot=s)

    def apply(self, changes: DataFrame, job: str, insert: bool = False) -> Snapshot:
        """The next snapshot: rows whose key is among the changes get the changed columns.

        ``changes`` has the key and the columns to set, one row a key.  Keys that the
        table lacks are added with ``insert`` (columns that are not given are null) and
        ignored without.  Without changes there is no new snapshot.
        """
        path, s = self.current()
        names = StructType.fromJson(json.loads(s.schema)).names
        given = [c for c in changes.columns if c != s.key]
        if unknown := [c for c in changes.columns if c not in names]:
            raise ValueError(f"the table has no columns {unknown}")
        folder = f"{self.root}/changes/{uuid.uuid4().hex}"
        changes.withColumn(BUCKET, self._bucket(s)).write.parquet(folder)  # the job runs once
        changes = self.spark.read.schema(StructType([*changes.schema.fields]).add(BUCKET, IntegerType())).parquet(folder)
        if not changes.groupBy(s.key).count().where("count > 1").isEmpty():
            raise ValueError(f"{job}: two changes of one {s.key}")
        touched = {r[0] for r in changes.select(BUCKET).distinct().collect()}  # at most ``buckets`` numbers
        if not insert:
            touched &= set(s.parts)
        if not touched:
            return s
        old = self.rows(buckets=touched, snapshot=s)
        new = changes.select(F.col(f"`{s.key}`").alias("__key"), F.lit(True).alias("__hit"), *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(given)))
        met = old.withColumn("__old", F.lit(True)).join(new, F.col(f"`{s.key}`").eqNullSafe(F.col("__key")), "full" if insert else "left")
        value = {c: F.when(F.col("__hit"), F.col(f"__{i}")).otherwise(F.col(f"`{c}`")) for i, c in enumerate(given)} | {s.key: F.when(F.col("__old"), F.col(f"`{s.key}`")).otherwise(F.col("__key"))}
        whole = met.select(*((value[c] if c in value else F.col(f"`{c}`")).cast(old.schema[c].dataType).alias(c) for c in names))
        parts = self._write(whole, s)
        kept = {k: v for k, v in s.parts.items() if k not in touched}
        after = replace(s, number=s.number + 1, job=job, before=path, parts=kept | parts, rewritten=tuple(sorted(touched)))
        self._commit(after, path)
        return after
