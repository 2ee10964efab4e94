"""Byte-level BPE by backtracking over longest matches.

Tokens are bytes; every byte is taken as the Latin-1 character of that number, so a
pyahocorasick automaton of the vocabulary finds the tokens at each place of a piece.
From the left the longest token is taken whose neighbour to the left is compatible with
it; where none is, the last token gives way to its next shorter prefix.  Two adjacent
tokens are compatible if the merges of their joined bytes give just these two, which is
remembered for every pair met.  A sequence whose neighbours are all compatible is what
the merges give, and there is one at most for each prefix of a piece; so a place that
failed once is never tried again, and the work grows linearly with the piece.

Texts are cut into pieces as arrays, a slice of texts at a time, and each distinct piece
of a slice is encoded once or found in the worker's memory.  Nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import U, flat, flat_points, mix, prefix_sums, slices, span_hash
from .token_counts import LETTER, NUMBER, WHITE, pre_tokens

#: Places of a worker's table of pairs, a power of two; a pair that finds its place taken takes it over.
PAIRS = 1 << 20
#: The same for pieces, and the ids that are kept for them; when these are full the table starts anew.
PIECES, ARENA = 1 << 19, 1 << 22
#: Bytes of a piece above which it is encoded by itself.
LONG = 96
#: The rank of what is no token; ids have 32 bits.
NONE = 1 << 32
#: Between pieces: no byte's Latin-1 character, so that no token crosses it.
BORDER = "\u0100"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a rank file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merges(ranks: dict[bytes, int], data: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
    """What merging the adjacent pair of least rank, the first of equals, comes to; for each merge its rank and the first and last part after it.

    For the short data of one token.
    """
    parts = [data[i : i + 1] for i in range(len(data))]
    offers = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    history = []
    while offers and (best := min(offers)) < NONE:
        i = offers.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del offers[i]
        for k in (i - 1, i):
            if 0 <= k < len(offers):
                offers[k] = ranks.get(parts[k] + parts[k + 1], NONE)
        history.append((best, parts[0], parts[-1]))
    return parts, history


def classes() -> np.ndarray:
    """The class of every code point as the library's own patterns have it."""
    import tiktoken

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((WHITE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(points)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


class Decoder:
    """The bytes of every token, one after another by id."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.length = np.full(size, -1, np.int64)
        in_order = sorted(ranks, key=ranks.get)
        ids, sizes = [ranks[t] for t in in_order], np.array([len(t) for t in in_order], np.int64)
        self.length[ids] = sizes
        self.begin = np.zeros(size, np.int64)
        self.begin[ids] = np.cumsum(sizes) - sizes
        self.blob = np.frombuffer(b"".join(in_order), np.uint8)

    def decode_all(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids one after another."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.length) or ids.min() < 0 or (self.length[ids] < 0).any()):
            raise ValueError("an id that the vocabulary does not have")
        return spread(self.blob, self.begin[ids], self.length[ids])


class Encoder(Decoder):
    """A vocabulary as an automaton, with what has been learnt of pairs and pieces."""

    def __init__(self, path: str):
        import ahocorasick

        self.ranks = read_ranks(path)
        super().__init__(self.ranks)
        if missing := [i for i in range(256) if bytes([i]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.token = {i: t for t, i in self.ranks.items()}
        # a token that its own merges do not give can be a whole piece, never a part of one
        self.parts: dict[bytes, int] = {}
        self.firsts: dict[int, list[tuple[int, bytes]]] = {}
        self.lasts: dict[int, list[tuple[int, bytes]]] = {}
        for t, i in self.ranks.items():
            left, history = merges(self.ranks, t)
            if len(left) == 1:
                self.parts[t] = i
                self.firsts[i] = [*((rank, first) for rank, first, _ in history), (NONE, t)]
                self.lasts[i] = [*((rank, last) for rank, _, last in history), (NONE, t)]
        self.shorter = np.full(len(self.length), -1, np.int32)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.parts.items():
            if len(t) > 1:  # a single byte is a token everywhere
                self.automaton.add_word(t.decode("latin-1"), i)
            self.shorter[i] = next((self.parts[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.parts), -1)
        self.automaton.make_automaton()
        self.single = np.array([*(self.ranks[bytes([i])] for i in range(256)), -1], np.int32)
        self.pair_key, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.piece_key, self.piece_begin, self.piece_size = np.zeros(PIECES, U), np.zeros(PIECES, np.int64), np.zeros(PIECES, np.int32)
        self.arena, self.used = np.zeros(ARENA, np.uint32), 0

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before both tokens are whole."""
        own, other = iter(self.lasts[left]), iter(self.firsts[right])
        last, first = self.token[left][-1:], self.token[right][:1]
        (own_rank, own_last), (other_rank, other_first) = next(own), next(other)
        across = self.ranks.get(last + first, NONE)
        while True:
            if across < own_rank and across <= other_rank and across < NONE:
                return False  # of equal ranks the one to the left comes first
            if own_rank <= other_rank:
                if own_rank == NONE:
                    return True
                changed, last = own_last is not last, own_last
                own_rank, own_last = next(own)
            else:
                changed, first = other_first is not first, other_first
                other_rank, other_first = next(other)
            if changed:
                across = self.ranks.get(last + first, NONE)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has.

        One pass of the automaton finds the longest token at every place of all pieces.
        Short pieces then advance together, one step of each a round; long ones go alone.
        """
        size = np.array([len(p) for p in pieces], np.int64)
        end = np.cumsum(size + 1) - 1
        start, n = end - size, int(end[-1]) + 1 if len(end) else 0
        joined = BORDER.join(p.decode("latin-1") for p in pieces)
        longest = self.single[np.frombuffer(f"{joined}{BORDER}".encode("utf-16-le"), np.uint16)] if pieces else np.zeros(0, np.int32)
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        longest[found[:, 0] - self.length[found[:, 1]] + 1] = found[:, 1]  # the last to end of those that begin here is the longest
        into = np.full(n, -1, np.int32)  # the token that ends before a place
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int32)
        into[end[whole >= 0]] = whole[whole >= 0]
        self.together(longest, into, *(x[(whole < 0) & (size <= LONG)] for x in (start, end)))
        for k in np.flatnonzero((whole < 0) & (size > LONG)).tolist():
            ids = self.backtrack(longest[start[k] : end[k]].tolist())
            into[start[k] + np.cumsum(self.length[ids])] = ids
        begins, at, left = np.zeros(n, bool), end.copy(), start
        while len(at):  # back from the ends, over the tokens that stood
            at = at - self.length[into[at]]
            begins[at] = True
            more = at > left
            at, left = at[more], left[more]
        at = np.flatnonzero(begins)
        owner = np.searchsorted(start, at, side="right") - 1
        order = np.append(at[1:], 0)
        order[np.append(owner[1:] != owner[:-1], True)] = end
        return into[order].astype(np.uint32), np.bincount(owner, minlength=len(pieces))

    def together(self, longest: np.ndarray, into: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Backtracking in all of [start, end) at once; ``into`` gets the token that ends before each place passed."""
        failed = np.zeros(len(longest), bool)
        at, token, last = start.copy(), longest[start], np.full(len(start), -1, np.int32)
        while len(at):
            stop = at + self.length[token]
            fits = ~failed[stop]
            asked = fits & (last >= 0)
            fits[asked] = self.compatible(last[asked], token[asked])
            into[stop[fits]] = token[fits]
            at, last = np.where(fits, stop, at), np.where(fits, token, last)
            token = np.where(fits, longest[at], self.shorter[token])
            stuck = np.flatnonzero(~fits & (token < 0))
            while len(stuck):  # no token fits here, so the one before gives way
                failed[at[stuck]] = True
                before = last[stuck]
                at[stuck] -= self.length[before]
                token[stuck] = self.shorter[before]
                last[stuck] = np.where(at[stuck] > start[stuck], into[at[stuck]], -1)
                stuck = stuck[token[stuck] < 0]
            open_ = at < end
            if not open_.all():
                at, token, last, start, end = (x[open_] for x in (at, token, last, start, end))

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair is compatible: as remembered at the pair's place of a fixed table, or else found out and put there."""
        key = left.astype(np.int64) * len(self.length) + right
        place = (mix(key.astype(U)) & U(PAIRS - 1)).astype(np.int64)
        out, lost = self.pair_fits[place], np.flatnonzero(self.pair_key[place] != key)
        if len(lost):
            new, first, which = np.unique(key[lost], return_index=True, return_inverse=True)
            fits = np.array([self.apart(*divmod(k, len(self.length))) for k in new.tolist()])
            out[lost] = fits[which]
            self.pair_key[place[lost[first]]] = new
            taken = self.pair_key[place[lost[first]]] == new  # of several pairs at one place the last stays
            self.pair_fits[place[lost[first[taken]]]] = fits[taken]
        return out

    def backtrack(self, longest: list[int]) -> list[int]:
        """The same in one long piece, given the longest token at each of its places."""
        size, shorter, fitting = self.length.tolist() if len(longest) > 4 * len(self.length) else self.length, self.shorter, functools.cache(self.apart)
        out: list[int] = []
        failed: set[int] = set()
        at, token = 0, longest[0]
        while at < len(longest):
            stop = at + int(size[token])
            if stop not in failed and (not out or fitting(out[-1], token)):
                out.append(token)
                at = stop
                token = longest[at] if at < len(longest) else -1
                continue
            token = int(shorter[token])
            while token < 0:
                failed.add(at)
                last = out.pop()
                at -= int(size[last])
                token = int(shorter[last])
        return out

    def encode_all(self, column: pa.Array, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets); a null text has none."""
        texts = column.fill_null("").to_pylist()
        points, off = flat_points(texts)
        data, bytes_off = flat(column)
        start = pre_tokens(points, off, kinds)
        end = np.append(start[1:], len(points))
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ids, of_piece = self.gathered("".join(texts), start, end, span_hash(prefix_sums(points), start, end))
        if not np.array_equal(self.decode_all(ids), data):  # two pieces share a hash: tell them apart by themselves
            text, number = "".join(texts), {}
            own = [number.setdefault(text[a:b], len(number)) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            self.forget()
            ids, of_piece = self.gathered(text, start, end, np.array(own, U) + U(1))
            self.forget()
        return ids, np.append(0, np.cumsum(of_piece))[np.searchsorted(start, off)]

    def gathered(self, text: str, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has; pieces of one key are taken as equal."""
        kinds, at, which = np.unique(keys, return_index=True, return_inverse=True)
        place = (kinds & U(PIECES - 1)).astype(np.int64)
        known = self.piece_key[place] == kinds
        new = np.flatnonzero(~known)
        n = self.piece_size[place].astype(np.int64)
        old = spread(self.arena, self.piece_begin[place[known]], n[known])
        ids, n[new] = self.encode_pieces([text[a:b].encode() for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
        begin = np.zeros(len(kinds), np.int64)
        begin[known], begin[new] = np.cumsum(n[known]) - n[known], len(old) + np.cumsum(n[new]) - n[new]
        if self.used + len(ids) > ARENA:
            self.forget()
        if len(ids) <= ARENA:
            self.arena[self.used : self.used + len(ids)] = ids
            self.piece_key[place[new]] = kinds[new]
            stay = new[self.piece_key[place[new]] == kinds[new]]  # of several pieces at one place the last stays
            self.piece_begin[place[stay]], self.piece_size[place[stay]] = begin[stay] - len(old) + self.used, n[stay]
            self.used += len(ids)
        return spread(np.append(old, ids), begin[which], n[which]), n[which]

    def forget(self) -> None:
        self.piece_key[:], self.used = 0, 0


def spread(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs values[start:start + n] one after another."""
    before = np.cumsum(n) - n
    return values[np.repeat(start - before, n) + np.arange(int(n.sum()))]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def _blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def encode(docs: DataFrame, path: str, packed: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids of every whole text, by the ranks in ``path`` and the usual pattern of such files.

    ``ids`` is an array of integers, or with ``packed`` its little-endian unsigned 32-bit
    form, as training shards have it.  Special tokens are not known: their strings are
    ordinary text.  A null or empty text has no ids.  Repeated rows repeat their result,
    null ids stay, other columns are ignored.
    """
    kinds = docs.sparkSession.sparkContext.broadcast(classes())  # a byte for every code point there is

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = own.encode_all(part.column("text"), kinds.value)
                out = _blobs(ids.astype("<u4").view(np.uint8), 4 * at) if packed else pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), out], names=["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, n_tokens long, ids {'binary' if packed else 'array<int>'}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` with ``data``: the bytes that ``ids`` stand for, packed or not.

    Ids may end inside a character, hence bytes and not a string.  Null ids give null;
    an id outside the vocabulary is an error.  A column ``data`` is replaced.
    """
    encoded = encoded.drop("data")
    packed = encoded.schema["ids"].dataType.simpleString() == "binary"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                column = part.column("ids")
                if packed:
                    rows = [np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, "<u4") for x in column]
                else:
                    rows = [np.array(x or [], np.int64) for x in column.to_pylist()]
                ids = np.concatenate(rows)
                ends = np.append(0, np.cumsum(own.length[np.clip(ids.astype(np.int64), 0, len(own.length) - 1)]))
                data = _blobs(own.decode_all(ids), ends[np.append(0, np.cumsum([len(r) for r in rows]))])
                if column.null_count:
                    data = pc.if_else(column.is_valid(), data, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, data], names=[*part.schema.names, "data"])

    return encoded.mapInArrow(apply, StructType([*encoded.schema.fields, StructField("data", BinaryType())]))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again."""
    back = decode(encode(docs, path, packed=True), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
