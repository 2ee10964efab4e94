"""Sinks of the five kinds of sources, and publishing by rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, column: str = "batch") -> None:
    """Overwrite, partitioned by the column where the frame has it; rows of a partition meet first, so files stay few.

    The rebalance hint lets Spark split a large partition among tasks.
    """
    if column in df.columns:
        df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_drift_batches(claims: DataFrame, path: str, legacy: str) -> None:
    """The legacy batch with ``paid_amount``, all others with ``amount_paid`` and a reason code."""
    old = claims.where(F.col("batch") == legacy).withColumnRenamed("paid", "paid_amount")
    new = claims.where(F.col("batch") != legacy).withColumnRenamed("paid", "amount_paid").withColumn("adjustment_reason_code", F.lit(None).cast("string"))
    old.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={legacy}")
    new.hint("rebalance", "batch").write.mode("append").partitionBy("batch").parquet(path)


def write_relational(frames: dict[str, DataFrame], root: str, text: int | None = None, connections: int = 16, batch: int = 10_000) -> None:
    """Each table in replace mode: by JDBC where ``root`` is a JDBC URL, else as Parquet; empty tables are skipped.

    By JDBC at most ``connections`` tasks write at once.  Text columns have the type that
    Spark's dialect of the database gives them, or with ``text`` are VARCHARs of so many
    characters, where the dialect's own type takes no filters (one database refuses nulls
    in such columns).
    """
    for name, df in frames.items():
        if root.startswith("jdbc:"):
            types = ", ".join(f"{c} VARCHAR({text})" for c, t in df.dtypes if t == "string" and text)
            options = {"url": root, "dbtable": name, "batchsize": str(batch), "numPartitions": str(connections), **({"createTableColumnTypes": types} if types else {})}
            df.write.mode("overwrite").format("jdbc").options(**options).save()
        elif not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_partner_feed(v1: DataFrame, v2: DataFrame, root: str, per_file: int = 10_000) -> None:
    """v1 rows pipe-delimited with nulls as empty text, v2 rows as one JSON array a file of bounded size."""
    v1.write.mode("overwrite").option("header", True).option("sep", "|").option("nullValue", "").option("emptyValue", "").csv(f"{root}/v1")
    slot = F.floor(F.monotonically_increasing_id() / per_file)
    arrays = v2.withColumn("__slot", slot).groupBy("__slot").agg(F.to_json(F.collect_list(F.struct(*v2.columns))).alias("value"))
    arrays.select("value").write.mode("overwrite").text(f"{root}/v2")


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write to a staging folder and rename it into place only on success."""
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(staging)
        if not fs.rename(src, dst):
            raise OSError(f"could not publish {path}")
    except BaseException:
        fs.delete(src, True)
        raise
