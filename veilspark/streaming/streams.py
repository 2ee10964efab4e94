"""Stream forms: replays collapsed, late rows marked, and masking on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def collapse_replays(stream: DataFrame, key: str, when: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark's delay; state older than that is dropped."""
    return stream.withWatermark(when, delay).dropDuplicatesWithinWatermark([key])


def mark_late(df: DataFrame, delivered: str, happened: str, days: int = 90) -> DataFrame:
    """Late rows are kept and flagged."""
    return df.withColumn("late", F.coalesce(F.datediff(delivered, happened) > days, F.lit(False)))


def run_once(spark: SparkSession, folder: str, schema, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 100) -> DataFrame:
    """All files of a folder through a streaming query into Parquet, then read back."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
