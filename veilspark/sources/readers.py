"""Scans of the five kinds of sources; an absent source reads as an empty frame of its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def key_bounds(spark: SparkSession, url: str, table: str, key: str) -> tuple[int, int] | None:
    """The least and the largest key, asked of the database; none for an empty table."""
    named = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    found = spark.read.format("jdbc").options(url=url, query=f"SELECT min({named}) AS low, max({named}) AS high FROM {table}").load().first()
    return None if found[0] is None else (int(found[0]), int(found[1]))


def read_relational(spark: SparkSession, root: str, table: str, schema: StructType, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32) -> DataFrame:
    """A relational table: by JDBC where ``root`` is a JDBC URL, else its Parquet export.

    With a numeric ``key`` the database is read in as many ranges as ``partitions`` says,
    between ``bounds`` or the bounds that it states itself.  Filters and columns are
    pushed down; names and types are those of ``schema``.
    """
    if root.startswith("jdbc:"):
        options = {"url": root, "dbtable": table}
        bounds = bounds or (key_bounds(spark, root, table, key) if key else None)
        if key and bounds:
            options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1] + 1), "numPartitions": str(partitions)}
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return spark.read.format("jdbc").options(**options, customSchema=types).load().select(*(F.col(f"`{c}`") for c in schema.names))
    path = f"{root}/{table}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else empty(spark, schema)


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """All ``batch=`` folders with their schemas merged; columns a batch lacks are null."""
    return spark.read.option("mergeSchema", True).option("basePath", root).parquet(root)


def read_ndjson(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object a line; blank lines are skipped, broken ones keep their text in ``_corrupt_record``."""
    whole = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").json(path)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headed CSV with every column as text."""
    return spark.read.option("header", True).schema(StructType([StructField(c, StringType()) for c in columns])).csv(path)


def payloads(spark: SparkSession, root: str, glob: str = "*.json", lines: bool = False) -> DataFrame:
    """value and source_file of every payload below ``root``: a file each, or with ``lines`` a line each, which lets large files be cut."""
    found = spark.read.option("wholetext", not lines).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(root)
    return found.select("value", F.col("_metadata.file_name").alias("source_file")).where("trim(value) <> ''")


def accepted(found: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of the payloads that are JSON arrays, payloads that are none): refused ones keep their text, file and reason."""
    is_array = F.ltrim("value").startswith("[")
    parsed = found.withColumn("__rows", F.when(is_array, F.from_json("value", f"array<{schema.simpleString()}>")))
    rows = parsed.where("__rows IS NOT NULL").select(F.explode("__rows").alias("r"), "source_file").select("r.*", "source_file")
    why = F.when(is_array, "broken").otherwise("no array")
    return rows, parsed.where("__rows IS NULL").select("value", "source_file", why.alias("reason"))


def read_partner_feed(spark: SparkSession, root: str, v1: dict[str, str], v2: StructType, old: str = "*.txt", new: str = "*.json", lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pipe-delimited v1 rows, JSON-array v2 rows), each with the file it came from; ``refused`` tells of the other payloads.

    ``v1`` maps the abbreviated names to their types.
    """
    text = StructType([StructField(c, StringType()) for c in v1])
    one = spark.read.option("header", True).option("sep", "|").option("pathGlobFilter", old).option("recursiveFileLookup", True).schema(text).csv(root)
    one = one.select(*(F.col(c).cast(t).alias(c) for c, t in v1.items()), F.col("_metadata.file_name").alias("source_file"))
    return one, accepted(payloads(spark, root, new, lines), v2)[0]


def refused(spark: SparkSession, root: str, v2: StructType, new: str = "*.json", lines: bool = False) -> DataFrame:
    """value, source_file, reason of the v2 payloads that give no rows."""
    return accepted(payloads(spark, root, new, lines), v2)[1]


def read_manifests(spark: SparkSession, root: str, pattern: str, schema: StructType) -> DataFrame:
    """Every manifest under a root, with the path it came from."""
    found = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True).json(root)
    return found.select("*", F.col("_metadata.file_path").alias("source_path"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path and length of every file; the contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def is_complete(spark: SparkSession, path: str) -> bool:
    """A run is trusted only once its job has committed."""
    return exists(spark, f"{path}/_SUCCESS")
