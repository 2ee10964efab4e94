"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and benchmark items are normalised alike: A-Z become a-z, the words are runs of
ASCII digits, letters and all non-ASCII characters, joined by single spaces.  The
automaton holds every window of consecutive item words; a document is scanned once,
and each match is mapped back to byte offsets of the original text.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NON_ALNUM, cut, ensure_checkpoint_dir, map_whole

#: Words of a window.
WINDOW = 10
#: Bytes of windows in one automaton; a larger benchmark is scanned in rounds, one job and one automaton each.
AUTOMATON_BYTES = 8 << 20

_TABLE = bytes(0x20 if NON_ALNUM[b] else int(LOWER[b]) for b in range(256))


def normalise(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def item_windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    words = normalise(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def windows_of(items: list[tuple[str | None, str]], size: int = WINDOW) -> dict[bytes, set[str]]:
    """Window -> the items that have it; an item without an id has windows but no name."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        for w in item_windows(text, size):
            found[w] |= set() if item is None else {item}
    return found


def automaton(windows: dict[bytes, set[str]]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for window, items in windows.items():
        built.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(items)))
    if windows:
        built.make_automaton()
    return built


class Round:
    """Items of one round as Spark ships them; a worker builds their automaton once and keeps the last one."""

    last: tuple = ("", None)

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        self.items, self.size, self.name = items, size, uuid.uuid4().hex

    def automaton(self):
        if Round.last[0] != self.name:
            Round.last = ("", None)
            Round.last = (self.name, automaton(windows_of(self.items, self.size)))
        return Round.last[1]


def scan(words: list[bytes], built) -> tuple[list[tuple[int, int]], set[str]]:
    """(merged word ranges inside an occurrence, items that occur)."""
    line = b" " + b" ".join(words) + b" "
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    starts: list[int] | None = None
    if not len(built):
        return [], items
    for end, (n, ids) in built.iter(line.decode("latin-1")):
        if starts is None:
            starts, at = [], 1
            for w in words:
                starts.append(at)
                at += len(w) + 1
        last = bisect_right(starts, end - 1)  # words that begin before the match's closing space
        ranges.append((last - n, last))
        items.update(ids)
    return merge(ranges), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Byte span of every word in the original text."""
    data, out, at = text.encode().translate(_TABLE), [], 0
    for w in data.split():
        at = data.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def rounds(benchmark: DataFrame, size: int = WINDOW, limit: int = AUTOMATON_BYTES) -> Iterator[Round]:
    """The items dealt by hash to as many rounds as their windows' bytes need; each passes the driver by itself."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    total = size * (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(1, -(-total // limit))
    for k in range(n):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield Round([(r.item, r.text) for r in mine.collect()], size)


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())]))
_SCHEMA = "n_words long, spans array<struct<first_word:long,end_word:long,start_byte:long,end_byte:long>>, items array<string>"


def spans_of(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    at = word_offsets(text) if ranges else []
    return [{"first_word": a, "end_word": b, "start_byte": at[a][0], "end_byte": at[b - 1][1]} for a, b in ranges]


def scanned(docs: DataFrame, round_: Round) -> DataFrame:
    """The columns but the text of every row, with n_words, spans and items of one round."""
    shared = docs.sparkSession.sparkContext.broadcast(round_)
    columns = [c for c in docs.columns if c != "text"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = shared.value.automaton()
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column("text").to_pylist():
                words = normalise(text)
                ranges, ids = scan(words, built) if words else ([], set())
                n_words.append(len(words))
                spans.append(spans_of(text, ranges))
                items.append(sorted(ids))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))})

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return docs.mapInArrow(find, kinds + _SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, n_words, spans (word ranges and their byte offsets in the text), items.

    A null or empty text has no words and no spans; an empty benchmark hits nothing;
    items with a null text are ignored, those with a null id hit but are not named.
    Repeated rows stay repeated.  A benchmark of more windows than one automaton holds is
    scanned in rounds: each writes its hits to the shared folder, and the hits of equal
    rows are merged and joined back.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = rounds(benchmark, size, limit)
    found = scanned(docs, next(parts))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/decontaminate-{uuid.uuid4().hex}"
    written = []
    for k, round_ in enumerate(parts, 1):
        hits = scanned(docs.select("text", *own_keys()), round_).where(F.size("spans") > 0)
        hits.write.parquet(f"{folder}/{k}")
        written.append(f"{folder}/{k}")
    if not written:
        return found
    first = scanned(docs.select("doc_id", "text", *own_keys()), next(rounds(benchmark, size, limit)))
    more = spark.read.parquet(*written).groupBy("__one", "__two").agg(F.flatten(F.collect_set("spans")).alias("__spans"), F.flatten(F.collect_set("items")).alias("__items"))
    both = first.join(more, ["__one", "__two"], "left")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for own, others in zip(batch.column("spans").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                every = own + (others or [])
                starts, ends = {s["first_word"]: s["start_byte"] for s in every}, {s["end_word"]: s["end_byte"] for s in every}
                spans.append([{"first_word": a, "end_word": b, "start_byte": starts[a], "end_byte": ends[b]} for a, b in merge([(s["first_word"], s["end_word"]) for s in every])])
            items = [sorted({*a, *(b or ())}) for a, b in zip(batch.column("items").to_pylist(), batch.column("__items").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.select("doc_id", "n_words", "spans", "items", "__spans", "__items").mapInArrow(merged, f"doc_id {kind}, {_SCHEMA}")


def own_keys() -> list:
    """Two hashes of a text: rows of equal text have equal hits."""
    return [F.xxhash64("text").alias("__one"), F.hash("text", F.lit(1)).alias("__two")]


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """Documents without any occurrence of a benchmark window, all columns kept.

    One occurrence drops the whole document; an item shorter than a window is one window,
    so an item of a single word drops every document with that word.  Clean documents
    pass unchanged, those with null or empty text too; a repeated row fares as its like.
    In rounds, each takes what the one before it kept.
    """
    at, columns = docs.columns.index("text"), docs.columns
    for k, round_ in enumerate(rounds(benchmark, limit=limit)):
        shared = docs.sparkSession.sparkContext.broadcast(round_)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            built = shared.value.automaton()
            for batch in batches:
                lines = [b"".join((b" ", b" ".join(normalise(t)), b" ")).decode("latin-1") for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([not (len(built) and next(built.iter(x), None)) for x in lines], pa.bool_()))

        docs = map_whole(cut(docs) if k else docs, keep, columns)
    return docs
