"""One small file that names the folder which readers see, swapped by a rename."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

NAME = "_current"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def files(spark: SparkSession, path: str, ending: str) -> int:
    """Files right below ``path`` whose names end so."""
    p, fs = _path(spark, path)
    return sum(s.isFile() and s.getPath().getName().endswith(ending) for s in fs.listStatus(p))


def read(spark: SparkSession, root: str) -> str | None:
    """The folder that the pointer below ``root`` names, or none."""
    p, fs = _path(spark, f"{root}/{NAME}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; one that is there already is an error."""
    p, fs = _path(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def swap(spark: SparkSession, root: str, folder: str, expected: str | None = "") -> None:
    """Make ``folder`` the one that readers see: a file beside the pointer is renamed over it.

    With ``expected`` the pointer must still name that folder (none: must be absent),
    else another writer came first and this is an error.
    """
    if expected != "" and read(spark, root) != expected:
        raise RuntimeError(f"another writer has changed {root}")
    target, fs = _path(spark, f"{root}/{NAME}")
    new, _ = _path(spark, f"{root}/.{NAME}-{uuid.uuid4().hex}")
    out = fs.create(new, False)
    out.writeUTF(folder)
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(new), context.makeQualified(target), options)
