"""Removal of repeated passages by longest-previous-factor arrays.

A window is a string of ``length`` bytes.  Equal windows hold the same 64-byte string
of least hash, so all suffixes that can share a window meet under that hash:

1.  Every text is cut into runs of consecutive windows with the same least hash.  A
    run is known by that hash (its key) and the hash of its bytes.
2.  A task settles equal runs of its own block of texts: later ones repeat the first, and
    only the first goes on.  Runs of all blocks then meet by key.  Runs of equal bytes
    repeat each other whole; one of them stands for all.  A key with a single run that
    holds its string once repeats nothing.
3.  The bytes of the remaining runs meet by key.  Their suffixes are sorted: ranks of 8
    bytes are joined into ranks of longer and longer prefixes, up to a window's length.
    The longest common prefixes of neighbours, and for every suffix the nearest one of
    smaller position before and after it in suffix order, give the longest previous
    factor; positions taken the other way give the longest later one.
4.  Bytes under a factor of at least ``length`` are removed: those of later copies, or
    of all copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import U, flat, map_whole, mix, pack, powers, prefix_sums, slices, span_hash, text_bytes, unpack_all

#: Bytes of a window, and of the strings whose least hash makes the key.
LENGTH, SEED = 200, 64
#: Bytes of text for each shard of keys.
SHARD_BYTES = 16 << 20
#: Distinct runs of one key that are sorted together; above it the windows are dealt out by their hash.
TOGETHER = 20_000
#: Bytes of runs that are sorted at once, unless one key has more; windows of hot keys that a task remembers.
SORTED_BYTES, REMEMBERED = 1_000_000, 200_000
DIRECT, ALONE, CONTEXT, HOT = 0, 1, 2, 3
#: Marks of a run: its string is in it twice; other runs of its block equal it.
AGAIN, MANY = 1, 2
SPANS = {"one": "int64", "two": "int32", "start": "uint32", "n": "uint32"}
RUN = {"key": "uint64", "same": "uint64", "row": "uint32", "start": "uint32", "n": "uint32", "again": "uint8"}


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    n = len(values)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, U)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Runs of windows of every document: key, same, row, start (in the document), n, again."""
    width = length - seed + 1
    if len(data) < length:
        return {k: np.zeros(0, v) for k, v in RUN.items()}
    sums = prefix_sums(data)
    _, down = powers(len(sums))
    hashes = mix((sums[seed:] - sums[:-seed]) * down[: len(sums) - seed])
    least = sliding_min(hashes, width)
    inside = np.zeros(len(least) + length, np.int64)
    long = np.diff(off) >= length
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    if not len(at):
        return {k: np.zeros(0, v) for k, v in RUN.items()}
    key = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, end, key = at[first], at[last], key[first]
    again = np.zeros(len(start), np.uint8)
    # positions low enough to be some window's least hash; equal ones close together mark their run
    block = 256
    tops = np.full(-(-len(hashes) // block) * block, 0, U)
    tops[: len(least)] = least
    tops = tops.reshape(-1, block).max(axis=1)
    tops = np.maximum(tops, np.append(tops[:1], tops[:-1]))
    low = np.flatnonzero(hashes <= np.repeat(tops, block)[: len(hashes)])
    order = np.lexsort((low, hashes[low]))
    low = low[order]
    pair = np.flatnonzero((hashes[low][1:] == hashes[low][:-1]) & (low[1:] - low[:-1] <= width))
    one, two = low[pair], low[pair + 1]
    r = np.searchsorted(end, two - width + 1 - 1)  # first run that can reach ``two``
    live = np.arange(len(one))
    while len(live):
        live = live[r[live] < len(start)]
        live = live[start[r[live]] <= one[live]]
        hit = live[(key[r[live]] == hashes[one[live]]) & (end[r[live]] + width - 1 >= two[live])]
        again[r[hit]] = 1
        r[live] += 1
    row = np.searchsorted(off, start, side="right") - 1
    return {"key": key, "same": span_hash(sums, start, end + length), "row": row.astype(np.uint32), "start": (start - off[row]).astype(np.uint32), "n": (end - start + 1).astype(np.uint32), "again": again}


def shard_runs(batches: Iterator[pa.RecordBatch], shards: int, length: int, keep: str) -> Iterator[pa.RecordBatch]:
    """Runs of blocks of texts, packed by shard of their keys; of equal runs the first, the others as spans that repeat."""

    def blobs(found: list[dict], ids: list[tuple]) -> pa.RecordBatch:
        cols = {k: np.concatenate([f[k] for f in found]) for k in RUN}
        one, two = (np.concatenate(x) for x in zip(*ids, strict=True))
        cols, new, _ = in_order(cols, one[cols["row"]], two[cols["row"]], keep)
        later = {k: v[~new] for k, v in cols.items()}
        copies = np.diff(np.append(np.flatnonzero(new), len(new)))
        cols = {k: v[new] for k, v in cols.items()}
        cols["again"] = cols["again"] | np.where(copies > 1, MANY, 0).astype(np.uint8)
        # equal widths of the hash would be uneven: a least hash is small
        of = (mix(cols["key"]) % U(shards)).astype(np.int64)
        by = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[by], np.arange(shards + 1))
        out: dict[str, list] = {"shard": [], "one": [], "two": [], "runs": [], "later": []}
        for s in range(shards):
            mine = by[bounds[s] : bounds[s + 1]]
            if len(mine):
                rows, local = np.unique(cols["row"][mine], return_inverse=True)
                part = {k: v[mine] for k, v in cols.items()} | {"row": local.astype(np.uint32)}
                out["shard"].append(s)
                out["one"].append(pack(x=one[rows]))
                out["two"].append(pack(x=two[rows]))
                out["runs"].append(pack(**part))
                out["later"].append(None)
        if len(later["row"]):
            at = later["row"]
            out["later"][int(one[at[0]]) % len(out["later"])] = pack(one=one[at], two=two[at], start=later["start"], n=later["n"])
        return pa.RecordBatch.from_pydict({"shard": pa.array(out["shard"], pa.int32()), "one": pa.array(out["one"], pa.binary()), "two": pa.array(out["two"], pa.binary()), "runs": pa.array(out["runs"], pa.binary()), "later": pa.array(out["later"], pa.binary())})

    found, ids, rows, size = [], [], 0, 0
    for batch in batches:
        for part in slices(batch, "text"):
            data, off = flat(part.column("text"))
            cut = runs(data, off, length)
            cut["row"] = cut["row"] + np.uint32(rows)
            found.append(cut)
            ids.append((part.column("one").to_numpy(), part.column("two").to_numpy()))
            rows += part.num_rows
            size += len(data)
            if size >= SHARD_BYTES:
                yield blobs(found, ids)
                found, ids, rows, size = [], [], 0, 0
    if found:
        yield blobs(found, ids)


def in_order(c: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, keep: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(runs by key, bytes and position; which differ from the one before; which have another key)."""
    order = np.lexsort((c["start"], two, one, c["same"], c["key"]))
    c, one, two = {k: v[order] for k, v in c.items()}, one[order], two[order]
    change = lambda v: np.append(True, v[1:] != v[:-1])[: len(v)]
    if keep == "first":  # rows of one id and text are one document
        own = change(c["key"]) | change(c["same"]) | change(one) | change(two) | change(c["start"])
        c = {k: v[own] for k, v in c.items()}
    new_key = change(c["key"])
    return c, new_key | change(c["same"]), new_key


def meet(pdf: pd.DataFrame, keep: str, together: int) -> pd.DataFrame:
    """Runs of a shard of keys: those that repeat whole, and those whose bytes must be compared."""
    parts = []
    for one, two, blob in zip(pdf["one"], pdf["two"], pdf["runs"], strict=True):
        p = unpack_all([blob], **RUN)
        p["one"] = unpack_all([one], x="int64")["x"][p["row"]]
        p["two"] = unpack_all([two], x="int32")["x"][p["row"]]
        parts.append(p)
    c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    c, new, new_key = in_order(c, c["one"], c["two"], keep)
    first = np.flatnonzero(new)
    kind_of, key_of = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    copies = np.diff(np.append(first, len(new)))
    many = ((copies > 1) | (np.bitwise_or.reduceat(c["again"], first) & MANY > 0))[kind_of]
    distinct = np.bincount(key_of, weights=new).astype(np.int64)[key_of]
    direct = ~new if keep == "first" else many
    compare = new & ((distinct > 1) | (c["again"] & AGAIN > 0))
    role = np.where(distinct > together, HOT, np.where(many & (keep != "first"), CONTEXT, ALONE))
    at = np.concatenate([np.flatnonzero(direct), np.flatnonzero(compare)])
    roles = np.concatenate([np.full(direct.sum(), DIRECT), role[compare]]).astype(np.int8)
    out = pd.DataFrame({"one": c["one"][at], "two": c["two"][at], "start": c["start"][at].astype(np.int32), "n": c["n"][at].astype(np.int32), "key": c["key"][at].view(np.int64), "role": roles})
    later = [b for b in pdf["later"] if b is not None]
    if not later:
        return out
    told = pd.DataFrame(unpack_all(later, **SPANS)).astype({"start": "int32", "n": "int32"})
    return pd.concat([out, told.assign(key=np.int64(0), role=np.int8(DIRECT))])


def ranked(keys: np.ndarray) -> np.ndarray:
    """The rank of every value among the distinct ones."""
    order = np.argsort(keys)
    new = np.append(False, keys[order][1:] != keys[order][:-1])
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def prefix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(h, rank of the h bytes from every position) for growing h up to ``length``; zeros follow the end."""
    bits = max(8, int(len(data) + length).bit_length())
    fit = max(2, 63 // bits)
    padded = np.append(data, np.zeros(length, np.uint8)).astype(U)
    width, packed = min(8, length), np.zeros(len(data), U)
    for k in range(width):
        packed = packed << U(8) | padded[k : k + len(data)]
    out = [(1, data.astype(np.int32)), (width, ranked(packed))]
    while width < length:
        rank = np.append(out[-1][1].astype(np.int64) + 1, np.zeros(length, np.int64))
        longer = min(width * fit, length)
        packed = rank[: len(data)]
        for k in range(1, -(-longer // width)):
            at = min(k * width, longer - width)
            packed = packed << bits | rank[at : at + len(data)]
        width = longer
        out.append((width, ranked(packed)))
    return out


def common_prefixes(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes, up to the longest of the ranked prefixes, that positions a and b have in common."""
    longest, whole = ranks[-1]
    out = np.where(whole[a] == whole[b], longest, 0)
    rest = np.flatnonzero(out < longest)
    a, b, off = a[rest], b[rest], np.zeros(len(rest), np.int64)
    for width, rank in reversed(ranks[:-1]):
        rank = np.append(rank, np.full(longest, -1, np.int32))
        for _ in range(8):
            same = rank[a + off] == rank[b + off]
            if not same.any():
                break
            off += width * same
    out[rest] = np.minimum(off, longest - 1)
    return out


def previous_factors(lcp: np.ndarray, position: np.ndarray, least: int) -> np.ndarray:
    """For suffixes in suffix order, the longest prefix that one of smaller position has too; factors below ``least`` count as none.

    ``lcp[k]`` is what suffix k has in common with the one before it.  The nearest suffix
    of smaller position on either side is found by jumps: where the candidate's position
    is larger, the candidate's own candidate follows.
    """
    n = len(position)
    best = np.zeros(n, np.int64)
    for step in (-1, 1):
        to = np.arange(n) + step
        have = lcp.copy() if step < 0 else np.append(lcp[1:], 0)
        live = np.flatnonzero(have >= least)
        while len(live):
            live = live[position[to[live]] > position[live]]
            ahead = to[live]
            have[live], to[live] = np.minimum(have[live], have[ahead]), to[ahead]
            live = live[have[live] >= least]
        best = np.maximum(best, np.where(have >= least, have, 0))
    return best


def repeated(runs: list[bytes], windows: np.ndarray, length: int, keep: str) -> np.ndarray:
    """Which windows of runs, in order of position, are later copies (or have any copy, if none is kept)."""
    data = np.frombuffer(b"".join(runs), np.uint8)
    first = np.append(0, np.cumsum([len(r) for r in runs]))[:-1]
    at = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    ranks = prefix_ranks(data, length)
    order = np.argsort(ranks[-1][1][at], kind="stable")
    lcp = np.append(0, common_prefixes(ranks, at[order][1:], at[order][:-1]))
    factor = previous_factors(lcp, order, length)
    if keep != "first":
        factor = np.maximum(factor, previous_factors(lcp, -order, length))
    out = np.zeros(len(at), bool)
    out[order] = factor >= length
    return out


def compare_runs(pdf: pd.DataFrame, length: int, keep: str) -> pd.DataFrame:
    """Factors of the runs of a shard; spans of those that occur elsewhere too."""
    told = pdf["role"] == DIRECT
    out = [pdf[told][["one", "two", "start"]].assign(stop=(pdf["start"][told] + length).to_numpy())]
    pdf = pdf[~told].sort_values(["key", "one", "two", "start"], kind="stable")
    if keep == "first":  # rows of one id and text are one document
        pdf = pdf.drop_duplicates(["key", "one", "two", "start"])
    sizes = pdf.groupby("key", sort=True)["n"].agg(lambda n: int(n.sum()) + len(n) * (length - 1))
    block = (sizes.cumsum() - 1) // SORTED_BYTES
    for _, group in pdf.groupby(pdf["key"].map(block), sort=False):
        group = group.sort_values(["one", "two", "start"], kind="stable")
        n = group["n"].to_numpy(np.int64)
        hit = repeated(group["data"].tolist(), n, length, keep) & np.repeat(group["role"].to_numpy() != CONTEXT, n)
        run = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + group["start"].to_numpy()[run]
        run, at = run[hit], at[hit]
        new = np.append(True, (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1))[: len(run)]
        if not len(run):
            continue
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(run)) - 1
        out.append(pd.DataFrame({"one": group["one"].to_numpy()[run[first]], "two": group["two"].to_numpy()[run[first]], "start": at[first], "stop": at[last] + length}))
    return pd.concat(out).astype({"one": "int64", "two": "int32", "start": "int32", "stop": "int32"})


class Hot:
    """Windows of hot keys as a task meets them: the first copy, and any of smaller position, goes on; the others repeat it."""

    def __init__(self, length: int, keep: str, shards: int):
        self.length, self.keep, self.shards, self.seen = length, keep, shards, {}

    def take(self, raw: bytes, run: dict, one: int, two: int) -> Iterator[tuple]:
        """(shard, one, two, start, role, bytes) of the windows of a run that go on, without bytes of those that repeat."""
        for start in range(run["start"], run["start"] + run["n"]):
            window, position = raw[start : start + self.length], (one, two, start)
            known = hashlib.blake2b(window, digest_size=16).digest()
            held = self.seen.get(known)
            told = lambda p: (p[0] % self.shards, *p, DIRECT, b"")
            if held is not None and (self.keep != "first" or held < position):
                yield told(position)
                if self.keep != "first" and held:
                    yield told(held)
                    self.seen[known] = ()
                continue
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[known] = position
            yield (int.from_bytes(known[:4], "big") % self.shards, *position, HOT, window)


def identified(docs: DataFrame) -> DataFrame:
    """Rows with an identity that orders them by id, and that null ids do not blur."""
    return docs.withColumns(dict(zip(("one", "two"), identity(docs), strict=True)))


def identity(docs: DataFrame) -> tuple[Column, Column]:
    own = F.xxhash64(F.col("doc_id").cast("string"), "text")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        own = F.coalesce(F.col("doc_id").cast("long"), own)
    return own, F.hash("text")


def removed_spans(rows: DataFrame, length: int = LENGTH, keep: str = "none", together: int = TOGETHER) -> DataFrame:
    """one, two, spans: byte spans to remove from each row (merged, in order)."""
    shards = max(12, -(-text_bytes(rows) // SHARD_BYTES))
    base = rows.select("one", "two", "text")
    found = base.mapInArrow(lambda b: shard_runs(b, shards, length, keep), "shard int, one binary, two binary, runs binary, later binary").groupBy("shard").applyInPandas(lambda p: meet(p, keep, together), "one long, two int, start int, n int, key long, role byte")
    direct = found.where(F.col("role") == DIRECT).select("one", "two", "start", (F.col("start") + F.col("n") + length - 1).alias("stop"))
    wanted = found.where(F.col("role") > DIRECT).groupBy("one", "two").agg(F.collect_list(F.struct("key", "start", "n", "role")).alias("runs"))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"shard": pa.int32(), "key": pa.int64(), "one": pa.int64(), "two": pa.int32(), "start": pa.int32(), "n": pa.int32(), "role": pa.int8(), "data": pa.binary()}
        hot = Hot(length, keep, shards)
        for batch in batches:
            batch = batch.filter(batch.column("runs").is_valid())
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for one, two, text, asked in zip(*(part.column(k).to_pylist() for k in ("one", "two", "text", "runs")), strict=True):
                    raw = text.encode()
                    for r in asked:
                        if r["role"] == HOT:
                            rows += [(shard, r["key"], a, b, start, 1, role, data) for shard, a, b, start, role, data in hot.take(raw, r, one, two)]
                        else:
                            rows.append((r["key"] % shards, r["key"], one, two, r["start"], r["n"], r["role"], raw[r["start"] : r["start"] + r["n"] + length - 1]))
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols, strict=True)})

    asked = base.join(wanted, ["one", "two"], "left").mapInArrow(bytes_of, "shard int, key long, one long, two int, start int, n int, role byte, data binary")
    compared = asked.groupBy("shard").applyInPandas(lambda p: compare_runs(p, length, keep), "one long, two int, start int, stop int")
    return direct.unionByName(compared).groupBy("one", "two").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last:a])
        last = b
    return b"".join([*kept, raw[last:]])


def digest(docs: DataFrame, length: int = LENGTH, keep: str = "none", together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A null text is empty; texts shorter than a window lose nothing; repeated rows are
    copies of each other.
    """
    rows = identified(docs.select("doc_id", "text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, cut = (text or "").encode(), merge(spans)
                for k, v in (("n_bytes", len(raw)), ("n_removed", sum(b - a for a, b in cut)), ("n_spans", len(cut)), ("kept_sha256", hashlib.sha256(without(raw, cut)).hexdigest())):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.select("one", "two", "text", "doc_id").join(removed_spans(rows, length, keep, together), ["one", "two"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """The documents with later copies of repeated passages cut from their texts.

    All columns stay; ``n_chars``, where present, is counted anew for changed texts.  A
    removed span is narrowed to whole characters, so every text stays valid.  The first
    copy, by id and position, keeps its bytes; with ``keep="none"`` no copy does.  Rows
    of one id and text count as one document here.
    """
    columns = docs.columns
    rows = identified(docs)
    at = columns.index("text")
    chars = columns.index("n_chars") if "n_chars" in columns else None

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(c) for c in columns]
            texts, counts = arrays[at].to_pylist(), []
            for i, spans in enumerate(batch.column("__spans").to_pylist()):
                if spans:
                    raw, whole = texts[i].encode(), []
                    for a, b in merge(spans):
                        while a < b and raw[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        whole.append((a, b))
                    texts[i] = without(raw, whole).decode()
                counts.append(len(texts[i]) if spans else None)
            arrays[at] = pa.array(texts, pa.string())
            if chars is not None:
                arrays[chars] = pa.array([o if n is None else n for n, o in zip(counts, arrays[chars].to_pylist(), strict=True)], arrays[chars].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    spans = removed_spans(rows, length, keep).select(F.col("one").alias("__one"), F.col("two").alias("__two"), F.col("spans").alias("__spans"))
    keyed = docs.withColumns(dict(zip(("__k1", "__k2"), identity(docs), strict=True)))
    joined = keyed.join(spans, (F.col("__k1") == F.col("__one")) & (F.col("__k2") == F.col("__two")), "left").select(*(F.col(f"`{c}`") for c in columns), "__spans")
    return map_whole(joined, strip, columns)
