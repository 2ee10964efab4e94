"""Interpolated modified Kneser-Ney language model of order two or three.

Tokens are words and one end for each text; the first token's context is a start.
Words are known by 56-bit hashes.  Trigrams are counted in Spark: tasks pack theirs by
shard, the words of a packed blob by local numbers.  A shard holds all trigrams with one
word in the middle, so that it knows by itself what follows ``u v`` and how many words
precede ``v w``; a middle word with more than a shard's share of all tokens is dealt out
by the word before it, and its words before ``v w`` are added up by ``v w`` in one more
step.  What shards learn about single words is merged by word.  The model is sorted
hash arrays, a file for each table and shard in the shared folder; workers map the files
into memory and look up all n-grams of a slice of texts at once.  Nothing of the model
passes through the driver but a few sums and the dealt words, at most one for each shard.

p(w | u v) = max(c(uvw) - D, 0) / c(uv) + (D1 n1 + D2 n2 + D3 n3)(uv) / c(uv) * p(w | v),
with discounts D1, D2, D3 for counts 1, 2 and 3 or more, n1, n2, n3 the followers of
``u v`` seen so often; p(w | v) has that form with the number of different words before
``v w`` for its count, or the count itself where v is the start, for which no trigram is
asked.  p(w) counts the different words before w in the same way and is interpolated
with the uniform distribution over all types and one unknown.  In order two p(w | v)
counts bigrams and is the last step.

A table keeps 32 bits of a hash beyond its place in a directory of some 16 keys a
place, so that an n-gram never seen is taken for a stored one about four times in a
thousand million look-ups, at every size.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, U, Words, ensure_checkpoint_dir, flat, mix, pack, slices, text_bytes, unpack

#: Bytes of text for each shard of the model and for each slice scored at once; tokens counted at once.
SHARD_BYTES, SLICE_BYTES, BLOCK_TOKENS = 12 << 20, 2 << 20, 1 << 21
#: Bytes of the model that a worker keeps mapped; beyond them it maps anew.
MAPPED_BYTES = 128 << 20
#: Share of the rows whose words tell which words are dealt out; it decides where counts lie and no result.
SAMPLE = 1 / 16
_BITS, _ID = U(8), 21
END, START = U(0x9AE16A3B2F904000), U(0xC949D7C7509E6500)
SHORT = {"key": "uint64"}
#: Of a trigram: local numbers of the middle word, the one before, the one after; its count.
CELL = {"key": "uint32", "before": "uint32", "after": "uint32", "n": "uint32"}
#: Of a bigram: its words; different words before it (its count in order two and at the start); its tokens.
ENDING = {"key": "uint64", "word": "uint64", "n": "uint64", "tokens": "uint64"}
#: Of a word: the sum over its followers; followers seen once, twice, more often; different words before it; tokens that it is.
WORD = dict.fromkeys(("key", "total", "n1", "n2", "n3", "left", "count"), "uint64")
#: Values that most rows of a table have; such rows are kept as keys alone.
USUAL = {"triple": (1,), "context": (1, 1, 0, 0), "ending": (1,), "late": (1,), "word": (1, 1, 0, 0, 1, 1)}


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, tokens of every text)."""
    w = Words(data, off, SPACE)
    return np.insert(w.hashes() >> _BITS << _BITS, w.at[1:], END), w.count + 1


def shifted(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before every token, the start for the first of a text."""
    out = np.append(START, token[:-1])
    out[first] = START
    return out


def starts(count: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(count))[:-1]


def bigram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * U(0xD6E8FEB86659FD93) + (word ^ (word >> U(31))))


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Equal widths of a hash of the key that has nothing in common with its own leading bits."""
    return (mix(key ^ U(0x589965CC75374CC3)) >> U(32)) * U(shards) >> U(32)


@dataclass(frozen=True)
class Layout:
    """The shards, and the words dealt out over several (sorted) with their numbers of parts."""

    shards: int
    dealt: np.ndarray
    parts: np.ndarray

    def is_dealt(self, word: np.ndarray) -> np.ndarray:
        return self.find(word) >= 0

    def find(self, word: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.dealt, word), len(self.dealt) - 1)
        return np.where(self.dealt[at] == word, at, -1)

    def cell(self, before: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Shard of a trigram with these first two words."""
        at = self.find(middle)
        part = np.where(at >= 0, mix(before) % np.maximum(self.parts[at], U(1)), U(0))
        return shard_of(middle + part, self.shards)


def groups(*columns: np.ndarray) -> np.ndarray:
    """Where a new row begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def add_at(first: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(c.astype(U), first) if len(first) else np.zeros(0, U) for c in columns]


def add_up(keys: tuple[np.ndarray, ...], *columns: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct keys, with the sums of the columns."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = groups(*keys)
    return [k[first] for k in keys], add_at(first, *(c[order] for c in columns))


def by_shard(of: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every shard that has rows, with their places in order."""
    order = np.argsort(of, kind="stable")
    touched, first = np.unique(of[order], return_index=True)
    bounds = [*first.tolist(), len(order)]
    for k, s in enumerate(touched.tolist()):
        yield s, order[bounds[k] : bounds[k + 1]]


def sorted_triples(middle: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, types: int) -> tuple[np.ndarray, ...]:
    """Distinct triples of numbers below ``types`` by middle, before and after, with the sums of n."""
    if types > 1 << _ID:
        keys, (n,) = add_up((middle, before, after), n)
        return (*keys, n)
    code = (middle.astype(U) << U(2 * _ID)) | (before.astype(U) << U(_ID)) | after.astype(U)
    if n.max(initial=1) > 1:
        order = np.argsort(code)
        code, n = code[order], n[order]
        first = groups(code)
        (n,) = add_at(first, n)
    else:
        code.sort()
        first = groups(code)
        n = np.diff(np.append(first, len(code))).astype(U)
    code = code[first]
    low = U((1 << _ID) - 1)
    return (code >> U(2 * _ID)), (code >> U(_ID)) & low, code & low, n


def block(token: np.ndarray, first: np.ndarray, layout: Layout, order: int) -> pa.RecordBatch:
    """Packed trigrams and first tokens of a block of whole texts, by shard."""
    types, which = np.unique(token, return_inverse=True)
    inner = np.ones(len(token), bool)
    inner[first] = False
    at = np.flatnonzero(inner)  # tokens with a token before them
    names = np.append(types, START)
    start = len(types)
    if order == 3:
        before = np.append(start, which[:-1])
        before[first] = start
        before = before[at - 1]
    else:
        before = np.full(len(at), start)
    v, u, w, n = sorted_triples(which[at - 1], before, which[at], np.ones(len(at), U), len(names))
    found: dict[int, list[bytes | None]] = {}
    for s, rows in by_shard(layout.cell(names[u], names[v]), layout.shards):
        used, local = np.unique(np.concatenate([v[rows], u[rows], w[rows]]), return_inverse=True)
        a, b, c = local.astype(np.uint32).reshape(3, -1)
        ids = np.argsort(np.argsort(names[used])).astype(np.uint32)  # the start's hash stands among the others
        a, b, c = ids[a], ids[b], ids[c]
        rank = np.argsort(a, kind="stable")
        cells = pack(key=a[rank], before=b[rank], after=c[rank], n=n[rows].astype(np.uint32)[rank])
        found[s] = [pack(key=np.sort(names[used]) >> _BITS), cells, None]
    word, (n,) = add_up((token[first],), np.ones(len(first), U))
    for s, blob in pack_endings(np.full(len(n), START), word[0], n, n, layout.shards):
        found.setdefault(s, [None, None, None])[2] = blob
    kinds = {"shard": pa.int32(), "names": pa.binary(), "cells": pa.binary(), "endings": pa.binary()}
    columns = [list(found), *([row[k] for row in found.values()] for k in range(3))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def pack_endings(before: np.ndarray, word: np.ndarray, n: np.ndarray, count: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    for s, rows in by_shard(shard_of(bigram(before, word), shards), shards):
        rows = rows[np.argsort(before[rows], kind="stable")]
        yield s, pack(key=before[rows] >> _BITS, word=word[rows] >> _BITS, n=n[rows].astype(U), tokens=count[rows].astype(U))


def count_blocks(batches: Iterator[pa.RecordBatch], layout: Layout, order: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for part in slices(batch, "text"):
            token, count = tokens(*flat(part.column("text")))
            if held and size + len(token) > BLOCK_TOKENS:
                yield block(np.concatenate(held), starts(np.concatenate(counts)), layout, order)
                held, counts, size = [], [], 0
            held.append(token)
            counts.append(count)
            size += len(token)
    if held:
        yield block(np.concatenate(held), starts(np.concatenate(counts)), layout, order)


def directory(key: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits of a place, where each place's keys begin, the next 32 bits of every key) of sorted keys."""
    bits = max(1, len(key).bit_length() - 4)
    begin = np.searchsorted(key >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
    return bits, begin.astype(np.uint32), (key >> U(32 - bits)).astype(np.uint32)


def write_table(folder: str, table: str, shard: int, key: np.ndarray, values: np.ndarray) -> None:
    """Rows of distinct keys: those of the usual values as keys, others with a byte a value, rows of larger values apart.

    The file appears whole or not at all, so that a repeated task does no harm.
    """
    from pyarrow import fs

    order = np.argsort(key)
    key, values = key[order], values[order]
    usual = (values == np.array(USUAL[table], U)).all(axis=1)
    one, more = directory(key[usual]), directory(key[~usual])
    values = values[~usual]
    large = np.flatnonzero((values > 255).any(axis=1))
    head = np.array([len(large), one[0], int(usual.sum()), more[0], len(values), 0, 0, 0], U)
    arrays = [head, values[large], large.astype(np.uint32), *one[1:], *more[1:], np.minimum(values, U(255)).astype(np.uint8)]
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/.{table}-{shard}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    store.move(temporary, f"{path}/{table}-{shard}")


class Table:
    """A written table mapped into memory."""

    def __init__(self, path: str, width: int):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        n_large, bits, n_one, more, n_more = (int(x) for x in raw[:64].view(U)[:5])
        at = 64

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return raw[at - n * np.dtype(kind).itemsize : at].view(kind)

        self.large = take(U, n_large * width).reshape(-1, width)
        self.large_at = take(np.uint32, n_large)
        self.one = (bits, take(np.uint32, (1 << bits) + 1), take(np.uint32, n_one))
        self.more = (more, take(np.uint32, (1 << more) + 1), take(np.uint32, n_more))
        self.values = take(np.uint8, n_more * width).reshape(-1, width)

    @staticmethod
    def find(part: tuple[int, np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where there is none."""
        bits, begin, rest = part
        if not len(rest):
            return np.full(len(key), -1)
        place = (key >> U(64 - bits)).astype(np.int64)
        want = (key >> U(32 - bits)).astype(np.uint32)
        low, end = begin[place].astype(np.int64), begin[place + 1].astype(np.int64)
        high = end.copy()
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = (rest[np.minimum(middle, len(rest) - 1)] < want) & (middle < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        return np.where((low < end) & (rest[np.minimum(low, len(rest) - 1)] == want), low, -1)

    def rows(self, key: np.ndarray, usual: tuple[int, ...]) -> np.ndarray:
        """Values of every key, zeros where the table has none."""
        out = np.zeros((len(key), len(usual)), U)
        at = self.find(self.more, key)
        hit = np.flatnonzero(at >= 0)
        out[hit] = self.values[at[hit]]
        if len(self.large_at):
            large = np.minimum(np.searchsorted(self.large_at, at[hit]), len(self.large_at) - 1)
            is_large = self.large_at[large] == at[hit]
            out[hit[is_large]] = self.large[large[is_large]]
        left = np.flatnonzero(at < 0)
        out[left[self.find(self.one, key[left]) >= 0]] = np.array(usual, U)
        return out


class Mapped:
    """Files of the model that this worker has open, up to a bound of bytes."""

    def __init__(self) -> None:
        self.tables: dict[tuple[str, str, int], Table] = {}
        self.size = 0

    def clear(self) -> None:
        self.tables.clear()
        self.size = 0

    def get(self, folder: str, table: str, shard: int) -> Table:
        """A file in place where the folder is mounted, else the copy that Spark ships; every shard has every table, so one that is absent is an error."""
        name = (folder, table, shard)
        if name not in self.tables:
            path = local_path(folder, f"{table}-{shard}")
            size = os.path.getsize(path)
            if self.size + size > MAPPED_BYTES:
                self.clear()
            self.size += size
            self.tables[name] = Table(path, len(USUAL[table]))
        return self.tables[name]


MAPPED = Mapped()


def local_path(folder: str, name: str) -> str:
    parts = urllib.parse.urlparse(folder)
    if parts.scheme in ("", "file"):
        return f"{parts.path}/{name}"
    from pyspark import SparkFiles

    return os.path.join(SparkFiles.get(os.path.basename(parts.path)), name)


def count_of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, U(5)).astype(np.int64), minlength=6)[1:5].tolist()


def followers(first: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Sums of n, and how many are 1, 2 and more, of the runs that begin at ``first``."""
    return add_at(first, n, n == 1, n == 2, n > 2)


def about_words(before: np.ndarray, word: np.ndarray, n: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """What bigrams (sorted by ``before``) of such values and tokens say about single words."""
    first = groups(before)
    context = before[first]
    (ends,), (left, count) = add_up((word,), np.ones(len(word), U), count)
    keys = np.unique(np.concatenate([context, ends]))
    cols = {"key": keys} | {k: np.zeros(len(keys), v) for k, v in WORD.items() if k != "key"}
    at = np.searchsorted(keys, context)
    for k, x in zip(("total", "n1", "n2", "n3"), followers(first, n), strict=True):
        cols[k][at] = x.astype(WORD[k])
    at = np.searchsorted(keys, ends)
    cols["left"][at], cols["count"][at] = left, count
    return cols


def send_words(cols: dict[str, np.ndarray], shards: int) -> list[tuple[int, bytes]]:
    return [(s, pack(**{k: (v[rows] >> _BITS if k == "key" else v[rows]) for k, v in cols.items()})) for s, rows in by_shard(shard_of(cols["key"], shards), shards)]


def merged_words(blobs) -> dict[str, np.ndarray]:
    parts = [unpack(b, **WORD) for b in blobs]
    (key,), sums = add_up((np.concatenate([p["key"] for p in parts]) << _BITS,), *(np.concatenate([p[k] for p in parts]) for k in WORD if k != "key"))
    return {"key": key} | {k: s.astype(WORD[k]) for k, s in zip([k for k in WORD if k != "key"], sums, strict=True)}


def merge_cells(pdf: pd.DataFrame, folder: str, layout: Layout, order: int) -> pd.DataFrame:
    """Write the shard's trigrams, contexts and endings; send on what they say about words and about endings of dealt words."""
    shard = int(pdf["shard"].iloc[0])
    sent: list[tuple[int, bytes | None, bytes | None]] = [(shard, None, b) for b in pdf["endings"] if b is not None]
    have = pdf["cells"].notna()
    ones = twos = [0] * 4
    if have.any():
        lists = [unpack(b, **SHORT)["key"] << _BITS for b in pdf["names"][have]]
        names, which = np.unique(np.concatenate(lists), return_inverse=True)
        at, parts = 0, []
        for blob, own in zip(pdf["cells"][have], lists, strict=True):
            c = unpack(blob, **CELL)
            local = which[at : at + len(own)]
            at += len(own)
            parts.append((local[c["key"]], local[c["before"]], local[c["after"]], c["n"]))
        v, u, w, n = sorted_triples(*(np.concatenate([p[k] for p in parts]) for k in range(4)), len(names))
        del parts, lists, which
        if order == 3:
            first = groups(v, u)
            context = bigram(names[u], names[v])
            write_table(folder, "context", shard, context[first], np.stack(followers(first, n), axis=1))
            write_table(folder, "triple", shard, bigram(context, names[w]), n[:, None])
            ones = count_of_counts(n)
            del context
        del u
        (v, w), (different, count) = add_up((v, w), np.ones(len(n), U), n)
        n = different if order == 3 else count
        late = layout.is_dealt(names)[v]
        sent += [(s, None, b) for s, b in pack_endings(names[v[late]], names[w[late]], n[late], count[late], layout.shards)]
        v, w, n, count = (names[v[~late]], names[w[~late]], n[~late], count[~late])
        write_table(folder, "ending", shard, bigram(v, w), n[:, None])
        twos = count_of_counts(n)
        sent += [(s, b, None) for s, b in send_words(about_words(v, w, n, count), layout.shards)]
    else:
        write_empty(folder, shard, *(("context", "triple") if order == 3 else ()), "ending")
    return table_of(shard, sent, {f"t{i + 1}": ones[i] for i in range(4)} | {f"n{i + 1}": twos[i] for i in range(4)})


def write_empty(folder: str, shard: int, *tables: str) -> None:
    """Tables without rows are files too, so that a file which is not there is one that was lost."""
    for table in tables:
        write_table(folder, table, shard, np.zeros(0, U), np.zeros((0, len(USUAL[table])), U))


def table_of(shard: int, sent: list, sums: dict[str, int]) -> pd.DataFrame:
    """What is sent to shards, and a row for the shard itself, which has the sums."""
    sent = [(shard, None, None), *sent]
    out = pd.DataFrame({"shard": [x[0] for x in sent], "words": [x[1] for x in sent], "endings": [x[2] for x in sent]}, dtype=object).astype({"shard": "int32"})
    for k, x in sums.items():
        out[k] = [int(x)] + [0] * (len(out) - 1)
    return out


def merge_endings(pdf: pd.DataFrame, folder: str, layout: Layout) -> pd.DataFrame:
    """Add up the endings of the start and of dealt words; send on all that is known of words."""
    shard = int(pdf["shard"].iloc[0])
    sums = {k: int(pdf[k].sum()) for k in pdf.columns if k[0] in "tn"}
    sent = []
    words = [b for b in pdf["words"] if b is not None]
    if words:
        sent += send_words(merged_words(words), layout.shards)
    blobs = [unpack(b, **ENDING) for b in pdf["endings"] if b is not None]
    if blobs:
        c = {k: np.concatenate([b[k] for b in blobs]) for k in ENDING}
        (before, word), (n, count) = add_up((c["key"] << _BITS, c["word"] << _BITS), c["n"], c["tokens"])
        write_table(folder, "late", shard, bigram(before, word), n[:, None])
        for i, x in enumerate(count_of_counts(n)):
            sums[f"n{i + 1}"] += x
        sent += send_words(about_words(before, word, n, count), layout.shards)
    else:
        write_empty(folder, shard, "late")
    return table_of(shard, [(*x, None) for x in sent], sums).drop(columns="endings")


def merge_words(pdf: pd.DataFrame, folder: str) -> pd.DataFrame:
    """Write the shard's words; return its share of the model's sums."""
    shard = int(pdf["shard"].iloc[0])
    out = {k: [int(pdf[k].sum())] for k in pdf.columns if k[0] in "tn"}
    blobs = [b for b in pdf["words"] if b is not None]
    left, count = np.zeros(0, U), np.zeros(0, U)
    if blobs:
        c = merged_words(blobs)
        left, count = c["left"].astype(U), c["count"]
        write_table(folder, "word", shard, c["key"], np.stack([c[k].astype(U) for k in WORD if k != "key"], axis=1))
    else:
        write_empty(folder, shard, "word")
    out |= {f"l{i + 1}": [x] for i, x in enumerate(count_of_counts(left[left > 0]))}
    return pd.DataFrame(out | {"l5": [int((left > 2).sum())], "tokens": [int(count.sum())], "types": [int((count > 0).sum())], "pairs": [int(left.sum())]})


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2 and more, from how many n-grams were seen 1, 2, 3 and 4 times."""
    n = [max(1, x) for x in (n1, n2, n3, n4)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.05 * k, 0.95 * k)) for k in (1, 2, 3))])


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the sums that all n-grams share."""

    folder: str
    layout: Layout
    tokens: int
    types: int
    pairs: int
    pair_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    left_over: float
    triple_discounts: tuple[float, ...] = ()

    def lookup(self, table: str, key: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Rows of the keys, each looked for in its shard; only shards of some key are opened."""
        out = np.zeros((len(key), len(USUAL[table])), U)
        for s, rows in by_shard(of, self.layout.shards):
            out[rows] = MAPPED.get(self.folder, table, s).rows(key[rows], USUAL[table])
        return out

    @staticmethod
    def rest(counts: np.ndarray, which: tuple[float, ...]) -> np.ndarray:
        """Counts less their discounts."""
        return np.maximum(0.0, counts - np.array(which)[np.minimum(counts, U(3)).astype(np.int64)])

    def score(self, word: np.ndarray, before: np.ndarray, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of every token in its context, token counts in training).

        Order three takes the tokens two places before, too.
        """
        types, which = np.unique(np.concatenate([word, before]), return_inverse=True)
        table = self.lookup("word", types, shard_of(types, self.layout.shards))
        w, v = which[: len(word)], which[len(word) :]
        p1 = (self.rest(table[:, 4], self.word_discounts) + self.left_over / (self.types + 1)) / max(1, self.pairs)
        ends, n = bigram(before, word), np.zeros(len(word), U)
        late = self.layout.is_dealt(types)[v]
        for name, mine in (("late", np.flatnonzero(late)), ("ending", np.flatnonzero(~late))):
            of = shard_of(ends[mine] if name == "late" else before[mine], self.layout.shards)
            n[mine] = self.lookup(name, ends[mine], of)[:, 0]
        total = table[:, 0].astype(float)[v]
        gamma = (table[:, 1:4].astype(float) @ np.array(self.pair_discounts[1:]))[v]
        p = np.where(total > 0, (self.rest(n, self.pair_discounts) + gamma * p1[w]) / np.maximum(1.0, total), p1[w])
        if self.triple_discounts:
            at = np.flatnonzero(before != START)
            context, of = bigram(earlier[at], before[at]), self.layout.cell(earlier[at], before[at])
            rows = self.lookup("context", context, of)
            at, context, of, rows = (x[rows[:, 0] > 0] for x in (at, context, of, rows))
            n = self.lookup("triple", bigram(context, word[at]), of)[:, 0]
            gamma = rows[:, 1:].astype(float) @ np.array(self.triple_discounts[1:])
            p[at] = (self.rest(n, self.triple_discounts) + gamma * p[at]) / rows[:, 0].astype(float)
        return np.log10(np.maximum(p, 1e-300)), table[w, 5]


def layout_of(rows: DataFrame, shards: int, order: int) -> Layout:
    """The start and, in order three, every word whose share of a sample's tokens is above a shard's are dealt out.

    At most one word for each shard is, as the shares sum to one.
    """
    parts = {int(START): 1}
    if order == 3:

        def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    word, n = np.unique(tokens(*flat(part.column("text")))[0], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"word": pa.array([*word.view(np.int64).tolist(), None], pa.int64()), "n": pa.array(np.append(n, n.sum()))})

        found = rows.sample(SAMPLE, 1).mapInArrow(heads, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        first = found.orderBy(F.desc("n"), F.asc_nulls_first("word")).limit(shards + 1).collect()  # all tokens, and every word above a shard's share
        parts |= {x.word % 2**64: -(-2 * x.n * shards // first[0].n) for x in first if x.word is not None and x.n * shards > first[0].n}
    dealt = sorted(parts)
    return Layout(shards, np.array(dealt, U), np.array([parts[x] for x in dealt], U))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and host that Spark takes it by, so that every machine writes to the same place."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def fit(docs: DataFrame, order: int = 2) -> Model:
    """Count all texts of ``docs`` (a null one is empty) and write the model's arrays."""
    if order not in (2, 3):
        raise ValueError(f"order {order}")
    spark = docs.sparkSession
    rows = docs.select("text")
    layout = layout_of(rows, max(12, -(-text_bytes(rows) // SHARD_BYTES)), order)
    folder = qualified(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/ngram-lm-{uuid.uuid4().hex}")
    above, pairs = [f"t{i}" for i in range(1, 5)], [f"n{i}" for i in range(1, 5)]
    tasks = min(layout.shards, 2000 + layout.shards // 4)
    longs = lambda names: "".join(f", {k} long" for k in names)
    cells = rows.mapInArrow(lambda b: count_blocks(b, layout, order), "shard int, names binary, cells binary, endings binary")
    none = F.lit(None).cast("binary")
    cells = cells.unionByName(spark.range(layout.shards).select(F.col("id").cast("int").alias("shard"), none.alias("names"), none.alias("cells"), none.alias("endings")))
    endings = cells.repartition(tasks, "shard").groupBy("shard").applyInPandas(lambda p: merge_cells(p, folder, layout, order), "shard int, words binary, endings binary" + longs(above + pairs))
    words = endings.repartition(tasks, "shard").groupBy("shard").applyInPandas(lambda p: merge_endings(p, folder, layout), "shard int, words binary" + longs(above + pairs))
    names = [*above, *pairs, *(f"l{i}" for i in range(1, 6)), "tokens", "types", "pairs"]
    sums = words.repartition(tasks, "shard").groupBy("shard").applyInPandas(lambda p: merge_words(p, folder), longs(names)[2:])
    s = sums.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in names)).first()
    if urllib.parse.urlparse(folder).scheme not in ("", "file") and s.tokens:
        spark.sparkContext.addFile(folder, recursive=True)
    low = discounts(s.l1, s.l2, s.l3, s.l4)
    return Model(folder, layout, s.tokens, s.types, s.pairs, tuple(discounts(*(s[k] for k in pairs))), tuple(low), float(low[1] * s.l1 + low[2] * s.l2 + low[3] * s.l5), tuple(discounts(*(s[k] for k in above))) if order == 3 else ())


def held_out() -> Column:
    """crc32 of the id as text, modulo 5, is 1; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    A null or empty text is its end alone.  An empty training table knows no token and
    gives every token the uniform probability of one unknown.  Repeated rows repeat
    their result.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = model.tokens + 0.5 * (model.types + 1)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                word, count = tokens(*flat(part.column("text")))
                first = starts(count)
                before = shifted(word, first)
                logp, c = model.score(word, before, shifted(before, first))
                base = np.add.reduceat(np.log10((c.astype(float) + 0.5) / whole), first)
                known = np.add.reduceat((c > 0).astype(np.int64), first)
                n = part.num_rows
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": pa.array(count.astype(np.int64)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, model.tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(np.add.reduceat(logp, first))})
        MAPPED.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def evaluate(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    scored = score(docs, fit(docs.where(~held_out()), order))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
