"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

A document's set holds its distinct 5-word shingles as 64-bit hashes.  Documents of
equal sets form a class, and one of each stands for it.  Candidates come from an
exact prefix filter: of a document's indexed shingles, ordered by how many documents
hold them (rarest first), two linked documents share one of the first ``d + 1``, where
``d`` shingles may be missing from the other.  Shingles of one document alone come
first, so a document that merely contains a popular passage has no candidates.

Families of candidates go to tasks as tiles.  Within a task documents are ordered by
size and cut into tiles; two tiles are compared only if their sizes can be linked; the
bits set in one signature and not in the other bound the overlap from above; where pairs
pass, the sorted shingles of the two tiles are intersected and the overlaps counted
exactly.  Every link is found and counted.  Families larger than a task's bound, in bytes
or in documents, are cut by size band and part; every pair of parts is one task's.

The index takes the lower half of the hash space: of ``m`` indexed shingles no more
than ``d`` can be missing from a linked document, as of the whole set.  Where half a
set does not exceed ``d`` the whole set is indexed.  Halves and whole sets are counted
apart, so that two documents order the same shingles alike: a document that may be
linked to a wholly indexed one, as its half is small too, is indexed both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import SPACE, U, Words, cut, few, flat, mix, pack, slices, text_bytes, unpack_all, windows
from .components import components, spread

#: Words of a shingle; links need 100 * overlap >= 75 * union.
WORDS, PERCENT = 5, 75
#: Bytes of text for each shard of the index and each block of documents.
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 16 << 20
#: Bytes of shingles and documents of a family that one task takes, and documents of a tile.
FAMILY_BYTES, FAMILY_DOCS, TILE = 48 << 20, 1536, 256
#: Documents of a block with a shingle from which they are counted together; the mark of such a count.
CROWD, NOBODY = 64, np.uint32(2**32 - 1)
#: Bits of an indexed shingle; the mark of one of a whole set.
BITS = 48
WHOLE = U(1 << BITS)
BAND = float(np.log(100 / PERCENT))


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every document of a flat buffer."""
    found = Words(data, off, SPACE)
    hashes = found.hashes()
    shingles = windows(hashes, words)
    out = []
    for a, b in zip(found.at[:-1], found.at[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(shingles[a : b - words + 1]))
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else np.zeros(0, U))
    return out


def missing(n):
    """Shingles of n that a linked document may lack."""
    return n - -(-n * PERCENT // 100)


def indexed(s: np.ndarray) -> list[np.ndarray]:
    """Keys of a sorted set by half, by the whole, or both ways.

    A linked partner has at least p n shingles, p the least similarity, and if its half
    is no more than the share 1 - p of its own set, then at most (1 - p * p) n lie in
    this half.
    """
    half, out = s[: np.searchsorted(s, U(1 << 63))], []
    if len(half) > missing(len(s)):
        out.append(half >> U(64 - BITS))
    if not out or len(half) * 10_000 <= (10_000 - PERCENT * PERCENT) * len(s):
        out.append(s >> U(64 - BITS) | WHOLE)
    return [k[np.append(True, k[1:] != k[:-1])] if len(k) else k for k in out]


def identities(sets: list[np.ndarray]) -> np.ndarray:
    """Two hashes of every set."""
    return np.array([[np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)), dtype=U)] for s in sets], U).reshape(-1, 2).view(np.int64)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the 128-bit identity of the set of every row."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*flat(part.column("text")))
                sums = identities(sets)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "one": pa.array(np.ascontiguousarray(sums[:, 0])), "two": pa.array(np.ascontiguousarray(sums[:, 1]))})

    return docs.select("doc_id", "text").mapInArrow(profile, "doc_id long, n_shingles long, one long, two long")


def index(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Shingles of blocks of documents, packed by shard; shard 0 also carries the block's documents, once for each way they are indexed.

    A shingle that many documents of the block have goes to its shard as one count, and
    who has it goes with the documents, so that no shingle gathers all its documents.
    """
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() << 32

    def block(number: int, ids: list[np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
        keys, of_doc = [], []
        for i, s in enumerate(sets):
            for key in indexed(s):
                keys.append(key)
                of_doc.append(i)
        sizes, n = np.array([len(k) for k in keys], np.int64), np.array([len(sets[i]) for i in of_doc], np.int64)
        key, doc = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.uint32), sizes)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        times = np.diff(np.append(first, len(key)))
        crowd = np.repeat(times >= CROWD, times)
        hot = pack(key=key[crowd], doc=doc[crowd])
        many = np.where(crowd, np.repeat(times, times), 1).astype(np.uint32)
        once = ~crowd
        once[first] = True
        doc = np.where(crowd, NOBODY, doc)[once]
        key, many = key[once], many[once]
        of = (mix(key) % U(shards)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(shards + 1))
        rows: dict[str, list] = {"shard": [], "block": [], "keys": [], "meta": [], "hot": []}
        for s in range(shards):
            mine = order[bounds[s] : bounds[s + 1]]
            if len(mine) or s == 0:
                rows["shard"].append(s)
                rows["block"].append(task + number)
                rows["keys"].append(pack(key=key[mine], doc=doc[mine], many=many[mine]))
                rows["meta"].append(pack(id=np.concatenate(ids)[of_doc], one=identities(sets)[:, 0][of_doc], n=n, m=sizes) if s == 0 else None)
                rows["hot"].append(hot if s == 0 else None)
        return pa.RecordBatch.from_pydict({"shard": pa.array(rows["shard"], pa.int32()), "block": pa.array(rows["block"], pa.int64()), "keys": pa.array(rows["keys"], pa.binary()), "meta": pa.array(rows["meta"], pa.binary()), "hot": pa.array(rows["hot"], pa.binary())})

    number, ids, sets, size = 0, [], [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            data, off = flat(part.column("text"))
            ids.append(part.column("doc_id").to_numpy())
            sets += shingle_sets(data, off)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield block(number, ids, sets)
                number, ids, sets, size = number + 1, [], [], 0
    if sets:
        yield block(number, ids, sets)


def shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: the shingles of two documents or more, with their counts, back by block."""
    parts = [unpack_all([b], key="uint64", doc="uint32", many="uint32") for b in pdf["keys"]]
    key, doc, many = (np.concatenate([p[k] for p in parts]) for k in ("key", "doc", "many"))
    block = np.repeat(np.arange(len(parts)), [len(p["key"]) for p in parts])
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(key) else np.zeros(0, np.int64)
    counts = np.empty(len(key), np.uint32)
    sums = np.add.reduceat(many[order], first, dtype=np.uint32) if len(first) else many[:0]
    counts[order] = np.repeat(sums, np.diff(np.append(first, len(key))))
    keep = counts > 1
    key, doc, counts, block = key[keep], doc[keep], counts[keep], block[keep]
    bounds = np.searchsorted(block, np.arange(len(parts) + 1))
    blobs = [pack(key=key[a:b], doc=doc[a:b], df=counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    out = pd.DataFrame({"block": pdf["block"], "keys": blobs, "meta": pdf["meta"], "hot": pdf["hot"]})
    return out[(bounds[1:] > bounds[:-1]) | pdf["meta"].notna()]


def prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block: the rarest shared shingles by which each document can meet a linked one."""
    meta = unpack_all([next(m for m in pdf["meta"] if m is not None)], id="int64", one="int64", n="int64", m="int64")
    c = unpack_all(pdf["keys"], key="uint64", doc="uint32", df="uint32")
    crowd = c["doc"] == NOBODY
    hot = unpack_all([next(m for m in pdf["hot"] if m is not None)], key="uint64", doc="uint32")
    if len(hot["key"]):
        order = np.argsort(c["key"][crowd])
        known, df = c["key"][crowd][order], c["df"][crowd][order]
        hot["df"] = df[np.searchsorted(known, hot["key"])]
        c = {k: np.concatenate([v[~crowd], hot[k]]) for k, v in c.items()}
    own = meta["m"] - np.bincount(c["doc"], minlength=len(meta["n"]))
    need = missing(meta["n"]) + 1 - own
    order = np.lexsort((c["key"], c["df"], c["doc"]))
    doc = c["doc"][order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    take = order[rank < need[doc]]
    return pd.DataFrame({"key": c["key"][take].view(np.int64), "doc_id": meta["id"][c["doc"][take]], "one": meta["one"][c["doc"][take]]})


def candidates(docs: DataFrame) -> DataFrame:
    """key, doc_id, one: every two linked documents of different sets have a key in common."""
    shards = max(12, -(-text_bytes(docs) // SHARD_BYTES))
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    packed = rows.mapInArrow(lambda b: index(b, shards), "shard int, block long, keys binary, meta binary, hot binary")
    back = packed.groupBy("shard").applyInPandas(shared, "block long, keys binary, meta binary, hot binary")
    return back.groupBy("block").applyInPandas(prefixes, "key long, doc_id long, one long")


class Signatures:
    """Bitmaps of sets, by tile and width."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.made = sets, {}

    def of(self, tile: int, bits: int) -> np.ndarray:
        if (tile, bits) not in self.made:
            part = self.sets[tile * TILE : (tile + 1) * TILE]
            out = np.zeros((len(part), bits // 64), U)
            for i, s in enumerate(part):
                at = (s & U(bits - 1)).astype(np.int64)
                np.bitwise_or.at(out[i], at >> 6, U(1) << (at & 63).astype(U))
            self.made[tile, bits] = out
        return self.made[tile, bits]


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Common elements of every set of ``a`` with every set of ``b``: the sorted elements of both sides are intersected once, and those in common counted by pair."""
    out = np.zeros((len(a), len(b)), np.float32)
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(all_a, all_b)

    def places(side, everything):
        at = np.minimum(np.searchsorted(common, everything), max(0, len(common) - 1))
        hit = np.flatnonzero(common[at] == everything) if len(common) else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(side)), [len(x) for x in side])[hit], at[hit]

    (row_a, at_a), (row_b, at_b) = places(a, all_a), places(b, all_b)
    for first in range(0, len(common), 4096):
        width = min(4096, len(common) - first)
        one, two = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, row, at in ((one, row_a, at_a), (two, row_b, at_b)):
            mine = (at >= first) & (at < first + width)
            m[row[mine], at[mine] - first] = 1
        out += one @ two.T
    return out.astype(np.int64)


def bounded(mine: np.ndarray, others: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """From bitmaps and sizes of two tiles, an upper bound on the overlap of every pair."""
    out = np.empty((len(mine), len(others)), np.int64)
    step = max(1, (1 << 19) // max(1, others.size))
    for i in range(0, len(mine), step):
        x = mine[i : i + step, None, :]
        lost = np.bitwise_count(x & ~others).sum(2, dtype=np.int64), np.bitwise_count(others & ~x).sum(2, dtype=np.int64)
        out[i : i + step] = np.minimum(n[i : i + step, None] - lost[0], m[None, :] - lost[1])
    return out


def link(ids: np.ndarray, sets: list[np.ndarray], weight: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(least id of the component, weight of the linked ones) of every document; with sides only pairs across them count."""
    order = np.array(sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i])))
    sets, ids = [sets[i] for i in order], ids[order]
    weight = np.ones(len(ids), np.int64) if weight is None else weight[order]
    side = side if side is None else side[order]
    n = np.array([len(s) for s in sets], np.int64)
    parent, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    signatures = Signatures(sets)

    def roots(x: np.ndarray) -> np.ndarray:
        while (parent[x] != x).any():
            x = parent[x]
        return x

    for a in range(0, len(sets), TILE):
        b = min(a + TILE, len(sets))
        bits = max(64, 1 << int(2 * n[b - 1] - 1).bit_length())
        least = int(np.searchsorted(n, -(-n[a] * PERCENT // 100)))
        for c in range(least // TILE * TILE, a + 1, TILE):
            d = min(c + TILE, len(sets))
            bound = bounded(signatures.of(a // TILE, bits), signatures.of(c // TILE, bits), n[a:b], n[c:d])
            pairs = (bound * (100 + PERCENT) >= PERCENT * (n[a:b, None] + n[None, c:d])) & (np.arange(a, b)[:, None] > np.arange(c, d)[None, :])
            if side is not None:
                pairs &= side[a:b, None] != side[None, c:d]
            x, y = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
            if not len(x):
                continue
            x, y = x + a, y + c
            found = overlaps([sets[i] for i in x], [sets[j] for j in y])
            hit = (found * (100 + PERCENT) >= PERCENT * (n[x][:, None] + n[y][None, :])) & pairs[np.ix_(x - a, y - c)]
            links[x] += hit @ weight[y]
            links[y] += hit.T @ weight[x]
            for k in np.flatnonzero(hit.any(1)):
                top = np.unique(roots(np.append(y[hit[k]], x[k])))
                parent[top] = top[0]
    top = roots(np.arange(len(sets)))
    least_id = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least_id, top, ids)
    root, out = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    root[order], out[order] = least_id[top], links
    return root, out


def linked(docs: DataFrame, families: DataFrame) -> DataFrame:
    """doc_id, root, links: components and weighed links inside every family (doc_id, one, family, n, weight)."""
    total, docs_in_all = families.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    families = few(families, docs_in_all)
    shards = max(12, -(-8 * total // (FAMILY_BYTES // 3)))
    band = F.floor(F.log(F.col("n").cast("double")) / BAND)
    size = families.groupBy("family").agg(F.sum("n").alias("size"), F.count("*").alias("n"))
    is_big = (8 * F.col("size") > FAMILY_BYTES) | (F.col("n") > FAMILY_DOCS)
    size = cut(few(size.select("family", "n", is_big.alias("big")), docs_in_all))
    n_big = size.where("big").count()
    kept = ["doc_id", "one", "weight", "family"]
    sized = spread(families.withColumn("band", band), size, "family", docs_in_all)
    placed = sized.where("NOT big").select(*kept, F.pmod(F.xxhash64("family"), F.lit(shards)).cast("string").alias("task"), F.lit("").alias("side"))
    if n_big:
        parts = F.ceil(F.greatest(8 * F.sum("n") / (FAMILY_BYTES // 3), F.count("*") / (FAMILY_DOCS // 3))).cast("int")
        bands = cut(few(sized.where("big").groupBy("family", "band").agg(parts.alias("parts"), F.count("*").alias("n")), docs_in_all))
        near = lambda d: bands.select("family", (F.col("band") - d).alias("band"), F.col("parts").alias(f"p{d}"))
        around = bands.join(near(1), ["family", "band"], "left").join(near(-1), ["family", "band"], "left")
        split = spread(sized.where("big").select(*kept, "band"), around, ["family", "band"], docs_in_all)
        split = split.withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        name = lambda *x: F.concat_ws(".", *[c.cast("string") for c in x])
        f, b, i = F.col("family"), F.col("band"), F.col("i")
        upto = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
        tasks = F.concat(
            F.transform(upto(F.col("parts")), lambda j: name(f, b, b, F.least(i, j), F.greatest(i, j))),
            F.transform(upto(F.coalesce("p1", F.lit(0))), lambda j: name(f, b, b + 1, i, j)),
            F.transform(upto(F.coalesce("p-1", F.lit(0))), lambda j: name(f, b - 1, b, j, i)),
        )
        placed = placed.unionByName(split.select(*kept, F.explode(tasks).alias("task"), name(b, i).alias("side")))
    per_doc = placed.groupBy(*kept).agg(F.collect_list(F.struct("task", "side")).alias("tasks"))
    kinds = {"task": pa.string(), "side": pa.string(), "family": pa.int64(), "doc_id": pa.int64(), "weight": pa.int64(), "shingles": pa.binary()}

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*flat(part.column("text")))
                own = identities(sets)[:, 0].tolist()
                columns = (part.column(k).to_pylist() for k in ("doc_id", "one", "family", "weight", "tasks"))
                rows = [(t["task"], t["side"], f, d, w, s.tobytes()) for s, is_, d, one, f, w, tasks in zip(sets, own, *columns, strict=True) if is_ == one for t in tasks]
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols, strict=True)})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        _, *of = pdf["task"].iloc[0].split(".")
        across = bool(of) and (of[0] != of[1] or of[2] != of[3])  # two parts: pairs within one are another task's
        for _, group in pdf.groupby("family", sort=False):
            group = group.drop_duplicates("doc_id")
            ids = group["doc_id"].to_numpy()
            root, links = link(ids, [np.frombuffer(b, U) for b in group["shingles"]], group["weight"].to_numpy(), pd.factorize(group["side"])[0] if across else None)
            out.append(pd.DataFrame({"doc_id": ids, "root": root, "links": links})[links > 0])
        return pd.concat(out)

    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    sets = texts.join(per_doc, "doc_id").mapInArrow(sets_of, "task string, side string, family long, doc_id long, weight long, shingles binary")
    links = sets.groupBy("task").applyInPandas(compare, "doc_id long, root long, links long")
    if not n_big:
        return links
    links = cut(links)
    found = components(links, "doc_id", "root").select(F.col("node").alias("doc_id"), F.col("component").alias("root"))
    return links.groupBy("doc_id").agg(F.sum("links").alias("links")).join(found, "doc_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row.

    A document of fewer than five words has its whole sequence as one shingle; one
    without words, or with a null text, has none, links with nothing and is its own
    component.  Rows of a null id belong to the class of their text but link nothing
    else.  Repeated rows repeat their result.  Rows of one id and different texts are
    documents of their own while texts equal theirs have a smaller id; of the others
    of that id, one, the same in every run, is compared and the rest only has its equals.
    ``n_links`` counts the other rows that a row links with, equal texts included.  Ids
    may be of any type; the smallest one names a component.  Two sets are taken as equal
    by 128 bits, two shingles by 64, ids that are no whole numbers by 64.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        named = near_duplicates(docs.select(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("doc_id"), "text"))
        ids = docs.select("doc_id", F.xxhash64("doc_id").alias("__own")).where("doc_id IS NOT NULL").distinct()
        found = named.join(ids.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__own"), "left")
        least = found.groupBy("component_id").agg(F.min("__id").alias("__least"))
        return found.join(least, "component_id", "left").select(F.col("__id").alias("doc_id"), "n_shingles", F.col("__least").alias("component_id"), "n_links")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    profile = cut(profiles(docs))
    classes = profile.where("n_shingles > 0").groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight"))
    nodes = classes.where("first IS NOT NULL").groupBy("first").agg(F.min(F.struct("one", "two", "n_shingles", "weight")).alias("x")).select("first", "x.*")
    keys = cut(candidates(docs).join(nodes.select(F.col("first").alias("doc_id"), "one"), ["doc_id", "one"], "left_semi"))
    meet = keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    n_keys = keys.count()
    edges = spread(keys.select("key", "doc_id"), meet, "key", n_keys).where("doc_id <> least").select("doc_id", "least")
    family = components(few(edges, n_keys), "doc_id", "least")
    sized = family.join(nodes.select(F.col("first").alias("node"), "one", F.col("n_shingles").alias("n"), "weight"), "node")
    families = cut(sized.select(F.col("node").alias("doc_id"), "one", F.col("component").alias("family"), "n", "weight"))
    links = linked(docs, families).withColumnRenamed("doc_id", "first")
    ours = nodes.join(links, "first").select("one", "two", "n_shingles", "root", "links")
    named = classes.join(ours, ["one", "two", "n_shingles"], "left").select("one", "two", "n_shingles", F.coalesce("root", "first").alias("component_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("weight").alias("n"))
    found = spread(profile.where("n_shingles > 0"), cut(named), ["one", "two", "n_shingles"], profile.count())
    alone = profile.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "n_links").unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of every component: the one whose id names it; all columns kept.

    Documents without words and rows of a null id stay.  Of repeated rows of the id that
    names a component, and of other texts under that id, one row stays.
    """
    found = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.join(found, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
