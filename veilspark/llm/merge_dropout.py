"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

The vocabulary file gives pieces and scores.  A text is cut before every run of spaces;
each chunk starts as single characters, and an agenda offers adjacent pairs whose
concatenation is a piece, best score first.  A keyed hash of seed, document, place of
the chunk, piece and place in the chunk decides whether an offered merge is skipped, so
a seed gives one segmentation and every occurrence of a word draws its own.  Characters
outside the vocabulary become byte pieces.  Nothing is normalised: a space is the meta
symbol, a literal meta symbol is bytes, and the pieces of a text concatenate to exactly
that text.

The chunks of a slice are merged together: those of one length form a matrix with a
column for each chunk, whose agenda is the column of the ranks of its adjacent pairs; a
round takes the best pair of every column.  Very long chunks have a heap each.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Table, U, flat_points, mix, slices

#: Chance that an offered merge is skipped.
DROPOUT = 0.1
META = "▁"
#: Characters of a chunk up to which it is merged in a matrix; bits of a place there; a rank that no pair has.
SHORT, PLACE_BITS, NONE = 48, 6, 1 << 40
_MASK = (1 << 64) - 1
_PIECE, _PLACE, _CHUNK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD1342543DE82EF95


class Codec:
    """Pieces of a vocabulary file as tables for encoding and decoding."""

    def __init__(self, path: str, seed: int = 0, dropout: float = DROPOUT):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.id: dict[str, int] = {}
        self.bytes_id = [0] * 256
        raw = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes_id[value] = i
                raw[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.id[piece] = i
                raw[i] = piece.replace(META, " ").encode()
        self.length = np.array([len(b) for b in raw], np.int64)
        self.at = np.append(0, np.cumsum(self.length))[:-1]
        self.table = np.frombuffer(b"".join(raw), np.uint8)
        order = sorted(self.id, key=lambda p: (-model.get_score(self.id[p]), self.id[p]))
        self.limit = min(int(dropout * (1 << 64)), _MASK)
        self.seed = seed
        # symbols: pieces by rank, then other characters that pieces hold; below -1 a character that none holds
        self.symbol = -2 - np.arange(0x110000, dtype=np.int64)
        number = {p: r for r, p in enumerate(order)}
        for c in sorted({c for p in order for c in p}):
            at = number.setdefault(c, len(number))
            if c != META:
                self.symbol[ord(c)] = at
        self.symbol[0x20] = number.get(META, self.symbol[0x20])
        self.character = list(number)
        self.id_of = np.array([self.id.get(p, -1) for p in number], np.int64)
        pairs = [(number[p[:k]], number[p[k:]], r) for r, p in enumerate(order) for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = Table(pair_key(left, right), rank)
        self.rank_of = {(a, b): r for a, b, r in pairs}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that two symbols make, NONE where they make none."""
        found = self.pairs.find(pair_key(left, right))
        return np.where(found < 0, NONE, found)

    def merge_together(self, sym: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, whether each is left) of chunks of one length, a column each, after all rounds of their agendas.

        The best rank goes first, the leftmost of equals; it is skipped for good if the
        hash of the chunk's key, the piece and its place is low.
        """
        size, n = sym.shape
        out, left = sym.copy(), np.ones((size, n), bool)
        sym = np.vstack([sym, np.full((1, n), -1)])  # no symbol lies beyond the ends
        after = np.repeat(np.arange(1, size + 2)[:, None], n, 1)
        before = np.repeat(np.append(size, np.arange(size))[:, None], n, 1)
        place = np.arange(size + 1)[:, None]
        agenda = np.full((size + 1, n), NONE << PLACE_BITS)
        if size > 1:
            agenda[:-2] = self.rank(sym[:-2].ravel(), sym[1:-1].ravel()).reshape(size - 1, n) << PLACE_BITS | place[:-2]
        whose = np.arange(n)
        while n:
            best = agenda.min(0)
            live = np.flatnonzero(best < NONE << PLACE_BITS)
            if 2 * len(live) < n:  # the others are done
                out[:, whose], n = sym[:-1], len(live)
                sym, after, before, agenda, whose, keys, best = sym[:, live], after[:, live], before[:, live], agenda[:, live], whose[live], keys[live], best[live]
                live = np.arange(n)
            at, rank = best[live] & (1 << PLACE_BITS) - 1, best[live] >> PLACE_BITS
            skipped = mix(keys[live] + rank.astype(U) * U(_PIECE) + at.astype(U) * U(_PLACE)) < U(self.limit)
            agenda[at[skipped], live[skipped]] = NONE << PLACE_BITS
            live, at, rank = live[~skipped], at[~skipped], rank[~skipped]
            gone = after[at, live]
            next_, prior = after[gone, live], before[at, live]
            sym[at, live], left[gone, whose[live]] = rank, False
            after[at, live], before[next_, live] = next_, at
            agenda[gone, live] = NONE << PLACE_BITS
            agenda[at, live] = self.rank(rank, sym[next_, live]) << PLACE_BITS | at
            agenda[prior, live] = self.rank(sym[prior, live], rank) << PLACE_BITS | prior
        return out, left

    def merge_heap(self, sym: list[int], key: int) -> list[int]:
        """The same for one chunk of any length."""
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(np.array(sym[:-1], np.int64), np.array(sym[1:], np.int64)).tolist()
        agenda = [(r, i) for i, r in enumerate(ranks) if r < NONE]
        heapq.heapify(agenda)
        ranks.append(NONE)
        while agenda:
            r, i = heapq.heappop(agenda)
            if ranks[i] != r:
                continue
            if scrambled(key + r * _PIECE + i * _PLACE) < self.limit:
                ranks[i] = NONE
                continue
            j = after[i]
            sym[i], ranks[j] = r, NONE
            sym[j] = -1
            k = after[i] = after[j]
            ranks[i] = self.rank_of.get((r, sym[k]), NONE) if k < n else NONE
            if k < n:
                before[k] = i
            at = before[i]
            if at >= 0:
                ranks[at] = self.rank_of.get((sym[at], r), NONE)
            for k in (i, at):
                if k >= 0 and ranks[k] < NONE:
                    heapq.heappush(agenda, (ranks[k], k))
        return [x for x in sym if x != -1]

    def encode_all(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, where each text's begin); a text's key and a chunk's place in it vary the draws."""
        points, off = flat_points([t or "" for t in texts])
        space, first = points == 0x20, np.zeros(len(points) + 1, bool)
        first[1:-1] = space[1:] & ~space[:-1]
        first[off] = True
        start = np.flatnonzero(first[:-1])
        size = np.diff(np.append(start, len(points)))
        before = np.searchsorted(start, off)  # chunks before each text
        text = np.repeat(np.arange(len(texts)), np.diff(before))
        drawn = mix(np.array([(k * _PIECE + self.seed) & _MASK for k in keys], U))
        own = mix(drawn[text] + (np.arange(len(start)) - before[text] + 1).astype(U) * U(_CHUNK))
        sym = self.symbol[points]
        left = np.ones(len(sym), bool)
        order = np.argsort(size, kind="stable")
        bounds = np.searchsorted(size[order], np.arange(SHORT + 2))
        for n in range(2, SHORT + 1):
            mine = order[bounds[n] : bounds[n + 1]]
            if len(mine):
                at = start[mine] + np.arange(n)[:, None]
                sym[at], left[at] = self.merge_together(sym[at], own[mine])
        for k in order[bounds[SHORT + 1] :].tolist():
            a, b = start[k], start[k] + size[k]
            found = self.merge_heap(sym[a:b].tolist(), int(own[k]))
            sym[a : a + len(found)] = found
            left[a + len(found) : b] = False
        known = np.append(0, np.cumsum(left))[off]
        sym, points = sym[left], None
        return self.ids_of(sym, known)

    def ids_of(self, sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of symbols, bytes for those that are no piece, and the bounds ``at`` carried over."""
        found = self.id_of[np.maximum(sym, 0)]
        other = np.flatnonzero((sym < 0) | (found < 0))
        raw = [(chr(-2 - x) if x < 0 else self.character[x]).encode() for x in sym[other].tolist()]
        count = np.ones(len(sym), np.int64)
        count[other] = [len(b) for b in raw]
        is_other = np.zeros(len(sym), bool)
        is_other[other] = True
        out = np.repeat(found, count)
        out[np.repeat(is_other, count)] = np.array(self.bytes_id)[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype(np.int32), np.append(0, np.cumsum(count))[at]

    def encode(self, text: str | None, key: int = 0) -> np.ndarray:
        """Piece ids of a text."""
        return self.encode_all([text], [key])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of a sequence of piece ids."""
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids):
            return b""
        return self.table[np.arange(ends[-1]) + np.repeat(self.at[ids] - (ends - length), length)].tobytes()


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix((left + 1).astype(U) << U(32) | (right + 1).astype(U) & U(0xFFFFFFFF))


def scrambled(x: int) -> int:
    """``mix`` of one number."""
    x &= _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


@functools.lru_cache(maxsize=4)
def codec(path: str, seed: int, dropout: float) -> Codec:
    return Codec(path, seed, dropout)


def key_of(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def encode(docs: DataFrame, path: str, seed: int = 0, dropout: float = DROPOUT) -> DataFrame:
    """doc_id and ids of every document; a null or empty text has none.

    Repeated rows repeat their result; equal texts of other ids draw merges of their own.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, seed, dropout)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = c.encode_all(part.column("text").to_pylist(), [key_of(d) for d in part.column("doc_id").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of encoded documents; null ids give a null text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, 0, 0.0)
        for batch in batches:
            texts = [None if x is None else c.decode(np.array(x, np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(apply, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, seed: int = 0, dropout: float = DROPOUT) -> DataFrame:
    """doc_id, n_bytes, n_pieces, n_byte_pieces, ids_sha256, lossless of every whole text.

    ``lossless`` says that the pieces decode to the very bytes of the text.  A null or
    empty text has no pieces.  Repeated rows repeat their result; equal texts of other
    ids are segmented in their own way.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, seed, dropout)
        is_byte = np.zeros(len(c.length), bool)
        is_byte[c.bytes_id] = True
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids, at = c.encode_all(texts, [key_of(d) for d in part.column("doc_id").to_pylist()])
                back, ends = memoryview(c.decode(ids)), np.append(0, np.cumsum(c.length[ids]))[at]
                bytes_before = np.append(0, np.cumsum(is_byte[ids]))[at]
                raws = [(t or "").encode() for t in texts]
                digests = [hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                lossless = [back[a:b] == raw for a, b, raw in zip(ends[:-1], ends[1:], raws, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array([len(r) for r in raws], pa.int64()), "n_pieces": pa.array(np.diff(at)), "n_byte_pieces": pa.array(np.diff(bytes_before)), "ids_sha256": pa.array(digests, pa.string()), "lossless": pa.array(lossless, pa.bool_())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, n_bytes long, n_pieces long, n_byte_pieces long, ids_sha256 string, lossless boolean")
