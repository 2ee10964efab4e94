"""Shared helpers of the training-data operators.

Texts reach Python as Arrow string columns.  ``slices`` cuts a batch into runs of a
few megabytes so that the numpy work on one run stays small whatever the batch
holds; ``flat`` views a run as one byte buffer with document offsets; ``Words``
finds the words of every document in that buffer without a Python loop.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

U = np.uint64
#: Short rows (a few numbers each) that are worth a task of their own.
ROWS_A_TASK = 10_000
#: Separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = U(0x9E3779B97F4A7C15)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only where none is named and the master is local (tests), a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` short rows in no more partitions than these fill.

    An empty task costs files and log lines too, and loops of small tables have many.
    """
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``size`` bytes of text; a longer text is a run by itself."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(lengths), 0
    while start < len(lengths):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); a null text is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(n, base, U)
            steps[0] = U(1)
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = the polynomial of data[i:j], shifted by i."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span [start, end)."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * _STEPS[4])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of every document of a flat buffer: spans, and where each document's begin."""

    def __init__(self, data: np.ndarray, off: np.ndarray, separator: np.ndarray):
        self.data, self.off = data, off
        inside = ~separator[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = off[:-1] < off[1:]
            first[off[:-1][full]] = inside[off[:-1][full]]
            last[off[1:][full] - 1] = inside[off[1:][full] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, off)
        self.count = np.diff(self.at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, A-Z taken as a-z."""
        return span_hash(prefix_sums(LOWER[self.data]), self.start, self.end)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n consecutive hashes (those across documents too)."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, U(n), U)
    for k in range(n):
        out = (out + hashes[k : k + size]) * _STEPS[k % 5]
        out ^= out >> U(29)
    return mix(out)


def pack(**columns: np.ndarray) -> bytes:
    """Equal-length columns as one compressed blob; sorted keys go as differences."""
    import zstandard

    out = []
    for name, a in columns.items():
        a = np.ascontiguousarray(a)
        if name == "key":
            a = np.diff(a, prepend=a.dtype.type(0))
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes, **kinds: str) -> dict[str, np.ndarray]:
    """The columns of ``pack``, given their dtypes in the same order."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = {k: np.dtype(v).itemsize for k, v in kinds.items()}
    n, at, out = len(raw) // sum(sizes.values()), 0, {}
    for k, v in kinds.items():
        a = np.ascontiguousarray(raw[at : at + n * sizes[k]].reshape(sizes[k], n).T).reshape(-1).view(v)
        out[k] = np.cumsum(a, dtype=a.dtype) if k == "key" else a
        at += n * sizes[k]
    return out


def unpack_all(blobs, **kinds: str) -> dict[str, np.ndarray]:
    parts = [unpack(b, **kinds) for b in blobs]
    return {k: np.concatenate([p[k] for p in parts]) for k in kinds}


def flat_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))


def address(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> U(64 - size.bit_length() + 1)).astype(np.int64)


class Table:
    """Open addresses of distinct hashes with values from 0: at least twice as many places as entries, the next free place taken."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (2 * len(hashes)).bit_length())
        self.key, self.value = np.zeros(size, U), np.zeros(size, np.int32)
        self.steps = 1
        at, left = address(hashes, size), np.arange(len(hashes))
        while len(left):  # all that are left try one place; one of each place's takers gets it
            free = self.key[at[left]] == 0
            mine, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.key[mine], self.value[mine] = hashes[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & (size - 1)
            self.steps += 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Values, -1 where the table has none."""
        out, at, left = np.full(len(hashes), -1, np.int64), address(hashes, len(self.key)), np.arange(len(hashes))
        for _ in range(self.steps):
            key = self.key[at[left]]
            hit = key == hashes[left]
            out[left[hit]] = self.value[at[left[hit]]]
            left = left[~hit & (key != 0)]
            if not len(left):
                break
            at[left] = (at[left] + 1) & (len(self.key) - 1)
        return out


def map_whole(df: DataFrame, apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kept: list[str]) -> DataFrame:
    """``mapInArrow`` whose result has the columns ``kept`` of ``df``, whatever their names are, dots included."""
    named, plain = df.columns, [f"c{i}" for i in range(len(df.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in apply(pa.RecordBatch.from_arrays(b.columns, names=named) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=plain[: len(kept)])

    fields = [df.schema[c] for c in kept]
    schema = StructType([StructField(p, f.dataType) for p, f in zip(plain, fields, strict=False)])
    return df.toDF(*plain).mapInArrow(run, schema).toDF(*kept)


def text_bytes(docs: DataFrame) -> int:
    from pyspark.sql import functions as F

    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
