"""Token counts by a two-tier look-up on the map side.

Tier one is a compact hash table of frequent pre-tokens: two numpy arrays, 64-bit hashes
at open addresses and token counts beside them, broadcast to every worker.  Tier two is
each worker's own cache: a pre-token that the table lacks is encoded once by the
tokenizer library and remembered across the tasks of that worker.  Pre-tokens are cut
and hashed a slice of texts at a time, and none is ever shuffled.  The table comes from
bounded per-partition summaries of the whole corpus; it only decides where a count is
looked up, never what it is.  Two pre-tokens are taken as equal by 64 bits.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, flat_points, prefix_sums, slices, span_hash

#: Pre-tokens that a partition reports, and that the broadcast table holds.
PER_PARTITION, TABLE = 8192, 65536
#: Pre-tokens that a worker's cache holds before its older half goes.
CACHE = 1_000_000
#: Classes of code points.
OTHER, LETTER, NUMBER, WHITE = range(4)
#: What may follow an apostrophe as a pre-token with it (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def classes(path: str) -> np.ndarray:
    """The class of every code point as the library's own pre-tokenizer has it.

    Letters and numbers of a newer Unicode than the library's are asked of the library.
    """
    import regex

    points = "".join(map(chr, [*range(0xD800), *[0x21] * 0x800, *range(0xE000, 0x110000)]))
    out = np.zeros(len(points), np.uint8)
    cut = tokenizer(path).pre_tokenizer.pre_tokenize_str
    for kind, pattern, probe in ((WHITE, r"\s+", None), (LETTER, r"\p{L}+", "a"), (NUMBER, r"\p{N}+", "1")):
        found = np.concatenate([np.arange(*m.span()) for m in regex.finditer(pattern, points)])
        if probe:
            ends = dict(span for _, span in cut("".join(f"{probe}{points[i]}\n\n" for i in found)))
            found = found[[ends.get(4 * k) == 4 * k + 2 for k in range(len(found))]]
        out[found] = kind
    return out


def pre_tokens(points: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of every text of a flat buffer of code points begin."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[points]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begins = first.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    # of the white space before a word, the last character stands apart; a space joins the word
    word = np.flatnonzero(begins[1:n] & ~first[1:n] & (kind[1:] != WHITE) & (kind[:-1] == WHITE)) + 1
    begins[word - 1] = True
    begins[word[points[word - 1] == 0x20]] = False
    # an apostrophe alone, not after a space, takes one of the endings
    lone = np.flatnonzero((points[:-1] == 0x27) & begins[: n - 1] & begins[1:n] & ~first[1:n] & (kind[1:] == LETTER))
    for ending in ENDINGS:
        at = lone[lone + len(ending) < n]
        for k, c in enumerate(ending, 1):
            at = at[(points[at + k] == ord(c)) & ~first[at + k]]
        begins[at + 1] = False
        begins[at + len(ending) + 1] = True
        lone = lone[~np.isin(lone, at)]
    return np.flatnonzero(begins[:n])


class Cut:
    """Pre-tokens of a slice of texts: spans, hashes and the text each lies in.

    Special strings are cut out before, as the library does; each is one token.
    """

    def __init__(self, column: pa.Array, path: str, kinds: np.ndarray):
        texts, of = column.fill_null("").to_pylist(), None
        self.special = np.zeros(len(texts), np.int64)
        for s in special_strings(path):
            for i in np.flatnonzero(pc.match_substring(column, s).fill_null(False).to_numpy(zero_copy_only=False)) if s else ():
                self.special[i] += texts[i].count(s)
        if self.special.any():
            split = [self.parts(t, special_strings(path)) if k else [t] for t, k in zip(texts, self.special, strict=True)]
            of = np.repeat(np.arange(len(texts)), [len(p) for p in split])
            texts = [t for p in split for t in p]
        self.text = "".join(texts)
        points, off = flat_points(texts)
        self.start = pre_tokens(points, off, kinds)
        self.end = np.append(self.start[1:], len(points))
        self.hashes = span_hash(prefix_sums(points), self.start, self.end)
        self.of = np.searchsorted(off, self.start, side="right") - 1
        if of is not None:
            self.of = of[self.of]

    def parts(self, text: str, special: list[str]) -> list[str]:
        out = [text]
        for s in special:
            out = [p for x in out for p in x.split(s)]
        return out


#: A worker's own counts by file and hash, in a younger and an older half.
_OWN: dict[str, list[dict[int, int]]] = {}


def lengths(cut: Cut, table: Table, path: str) -> np.ndarray:
    """Tokens of every pre-token: from the table, else from the worker's cache, else from the library."""
    out = table.find(cut.hashes)
    lost = np.flatnonzero(out < 0)
    if len(lost):
        kinds, at, which = np.unique(cut.hashes[lost], return_index=True, return_inverse=True)
        halves = _OWN.setdefault(path, [{}, {}])
        young, old = halves
        found = [young.get(h, -1) if h in young else old.get(h, -1) for h in kinds.tolist()]
        new = [k for k, n in enumerate(found) if n < 0]
        if new:
            spans = lost[at[new]]
            strings = [cut.text[a:b] for a, b in zip(cut.start[spans].tolist(), cut.end[spans].tolist(), strict=True)]
            for k, e in zip(new, tokenizer(path).encode_batch(strings, add_special_tokens=False), strict=True):
                found[k] = len(e)
            if len(young) > CACHE // 2:
                young, _ = halves[:] = {}, young
            young.update(zip(kinds[new].tolist(), (found[k] for k in new), strict=True))
        out[lost] = np.array(found, np.int64)[which]
    return out


def frequent(docs: DataFrame, path: str, kinds) -> Table:
    """The most frequent pre-tokens of the corpus, at most ``TABLE``, with their token counts."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                cut = Cut(part.column("text"), path, kinds.value)
                keys, at, n = np.unique(cut.hashes, return_index=True, return_counts=True)
                for k, i, c in zip(keys.tolist(), at.tolist(), n.tolist(), strict=True):
                    if k in seen:
                        seen[k][0] += c
                    elif cut.end[i] - cut.start[i] <= 64:  # a longer one is left to the caches
                        seen[k] = [c, cut.text[cut.start[i] : cut.end[i]]]
                if len(seen) > 64 * PER_PARTITION:
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1][0])[: 8 * PER_PARTITION])
        top = sorted(seen.values(), key=lambda x: -x[0])[:PER_PARTITION]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for _, p in top], pa.string()), "n": pa.array([n for n, _ in top], pa.int64())})

    rows = docs.select("text").mapInArrow(summarise, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE).collect()
    found = [r.piece for r in rows]
    points, off = flat_points(found)
    encoded = tokenizer(path).encode_batch(found, add_special_tokens=False)
    return Table(span_hash(prefix_sums(points), off[:-1], off[1:]), np.array([len(e) for e in encoded], np.int64))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    A null or empty text has no bytes and no tokens.  Special strings inside a text
    count as one token each, as the library takes them by default.  Repeated rows and
    null ids stay as they are; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    kinds = context.broadcast(classes(path))  # a byte for every code point there is
    table = context.broadcast(frequent(docs, path, kinds))  # at most ``TABLE`` entries

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text")
                cut = Cut(text, path, kinds.value)
                n_tokens = cut.special + np.bincount(cut.of, lengths(cut, table.value, path), part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), "n_tokens": pa.array(n_tokens), "over_limit": pa.array(n_tokens > limit)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
