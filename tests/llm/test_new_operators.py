"""Fill-in-the-middle, byte-level BPE and the Merkle manifest: brute force, the libraries themselves, round trips, odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from veilspark.llm import byte_bpe, fill_middle, merkle

RANKS = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ODD = "doc_id long, text string, source string, lang string, n_chars long, h1 string, n int, form string, ids string, data string, leaf int, path string"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    r = random.Random(9)
    texts = [None, "", " ", "\n\t ", "word", "word ", " é", "a<P>b", "x <S> y", "<M>", "ends with <", "> begins", "x " * 40_000, "é😀ß " * 900, "=" * 3000, "don't we'll 'd 123 ½ Ⅷ", "<|endoftext|>", "Ａ　b c", "A b C", "A b C"]
    texts += ["".join(r.choice("ab éЖ中😀 \n\t<PSM>") for _ in range(r.randint(1, 60))) for _ in range(80)]
    out = [(i, t, None if i % 9 == 0 else f"s{i % 4}", None if i % 5 == 0 else "en", None if i % 6 == 0 else len(t or ""), "h", 1, "f", "i", "d", 2, "p") for i, t in enumerate(texts)]
    return [*out, out[18], out[18], (None, "Without Id", "s1", "en", 3, None, None, None, None, None, None, None), (None, "Other Text", "s1", None, None, None, None, None, None, None, None, None), (None,) * 12]


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame(rows, ODD).repartition(3).persist()


# Fill in the middle


def brute_fill(doc_id, text, seed=42):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, sha(t), sha(t)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(t)


def test_fill_in_middle_equals_brute_force(odd, rows):
    got = fill_middle.digest(odd).collect()
    want = [(r[0], *brute_fill(r[0], r[1])) for r in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {"plain", "spm", "psm"} == {g.form for g in got}
    assert fill_middle.digest(odd.limit(0)).collect() == []


def test_character_cuts_restore_every_text(odd, rows):
    got = fill_middle.transform(odd, seed=3, unit="char", transformed=100).withColumn("back", fill_middle.restored()).collect()
    assert sorted((g.doc_id, g.back) for g in got if g.doc_id is not None) == sorted((r[0], r[1] or "") for r in rows if r[0] is not None)
    for g in got:
        if g.form != "plain":
            assert g.n == len(g.back) and g.prefix_chars + g.middle_chars <= g.n
            part = re.split("<P>|<S>|<M>", g.output)
            assert (len(part[2 if g.form == "spm" else 1]), len(part[3])) == (g.prefix_chars, g.middle_chars)
    with pytest.raises(ValueError):
        fill_middle.transform(odd, unit="line")


def test_exceptions_turn_bytes_into_points_and_back():
    text = "aé中😀b" * 50 + "plain" * 9 + "ß"
    data = np.frombuffer(text.encode(), np.uint8)
    index = fill_middle.Exceptions(data)
    points = np.arange(len(text) + 1)
    byte = np.array([len(text[:k].encode()) for k in points])
    assert (index.to_bytes(points) == byte).all() and (index.to_points(byte) == points).all()
    assert not len(fill_middle.Exceptions(np.frombuffer(b"ascii only", np.uint8)).byte)


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_equals_the_library(odd, rows, library):
    got = byte_bpe.digest(odd, RANKS).collect()
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r[1] or "")))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.digest(odd.limit(0), RANKS).collect() == []


def test_byte_bpe_of_random_pieces(library):
    r, own, kinds = random.Random(5), byte_bpe.Encoder(RANKS), byte_bpe.classes()
    tokens = list(own.ranks)
    texts = ["".join(r.choice(tokens).decode("utf-8", "ignore") for _ in range(r.randint(1, 25))) for _ in range(1500)]
    texts += ["".join(r.choice("abcdeinrst ") for _ in range(r.randint(1, 200))) for _ in range(500)]
    texts += [c * n for c in "a=-. \n" for n in (95, 96, 97, 700)] + ["ab" * 400, "aab" * 300]
    for part in (texts, texts[::-1]):  # from an empty memory, then from a full one
        ids, at = own.encode_all(pa.array(part), kinds)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode_ordinary(t) for t in part]


def test_byte_bpe_when_hashes_or_memory_fail(library, monkeypatch):
    texts = ["one two three", "four five six seven", "antidisestablishmentarianism"]
    want = [library.encode_ordinary(t) for t in texts]
    kinds = byte_bpe.classes()
    monkeypatch.setattr(byte_bpe, "ARENA", 8)
    own = byte_bpe.Encoder(RANKS)
    for _ in range(3):
        ids, at = own.encode_all(pa.array(texts), kinds)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    monkeypatch.setattr(byte_bpe, "span_hash", lambda sums, start, end: np.zeros(len(start), np.uint64) + (end - start).astype(np.uint64))
    ids, at = byte_bpe.Encoder(RANKS).encode_all(pa.array(texts), kinds)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want


def test_backtracking_where_the_longest_token_is_wrong(tmp_path):
    """A vocabulary whose longest match fails: abc is a token, but the merges take bc first and then bcd."""
    import base64

    tokens = [bytes([i]) for i in range(256)] + [b"bc", b"ab", b"bcd", b"abc", b"xyz"]
    path = tmp_path / "small.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    own, lib = byte_bpe.Encoder(str(path)), tiktoken.Encoding("s", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert b"xyz" not in own.parts and own.ranks[b"xyz"] == 260  # no merge gives it: a whole piece at most
    r = random.Random(1)
    texts = ["xyz", "xyzx", "abcd", "abcabcd", *("".join(r.choice("abcdxyz") for _ in range(r.randint(1, 130))) for _ in range(400))]
    ids, at = own.encode_all(pa.array(texts), byte_bpe.classes())
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [lib.encode_ordinary(t) for t in texts]


def test_decode_arrays_and_bad_ids(spark, odd, rows):
    arrays = byte_bpe.encode(odd, RANKS)
    assert dict(arrays.dtypes)["ids"] == "array<int>"
    back = byte_bpe.decode(arrays, RANKS).collect()
    assert sorted((b.doc_id, bytes(b.data).decode()) for b in back if b.doc_id is not None) == sorted((r[0], r[1] or "") for r in rows if r[0] is not None)
    assert byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).first().data is None
    with pytest.raises(Exception, match="does not have"):
        byte_bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>"), RANKS).collect()


# Merkle manifest


def brute_merkle(rows):
    """doc_id, leaf, subroot, root, proof, folded, verified of (doc_id, source, lang, n_chars, text), as the definition says."""

    def leaf(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        """Root, and for every node its siblings (left, right) level by level."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k in range(len(nodes)):
                run = at[k] // 16 * 16
                paths[k].append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + 16])))
                at[k] //= 16
            level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        return level[0], paths

    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0], leaf(*r), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in by_source[s]])
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        subroot, paths = trees[s]
        for (doc_id, own, r), path in zip(by_source[s], paths, strict=True):
            path, node = path + top, own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and r[4] is not None:
                node = leaf(*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            for left, right in path:
                node = sha(left + node + right)
            out.append((doc_id, own, subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def test_merkle_equals_the_definition(odd, rows):
    got = merkle.verify(odd).collect()
    want = brute_merkle([(r[0], r[2], r[3], r[4], r[1]) for r in rows])
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {True, False} == {g.verified for g in got}
    assert merkle.verify(odd.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300])
def test_merkle_of_one_source_of_every_depth(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    got = merkle.verify(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_merkle(rows))


def test_merkle_of_many_blocks_and_sources(spark, monkeypatch):
    """Blocks of 16 leaves make roots recurse several times, in a hot source, in the sources' tree, and over ranges that cut a source."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    monkeypatch.setattr(merkle, "ROWS", 100)
    r = random.Random(2)
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(700)]
    rows += [(i, r.choice([None, *(f"s{k}" for k in range(40))]), "en", i, f"Other {i}") for i in range(700, 1100)]
    rows += [(5, "hot", "en", 5, "Text 5")] * 40  # a repeated row over several blocks
    got = merkle.verify(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_merkle(rows))


def test_merkle_paths_verify_rows_alone(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.manifest(docs)
    assert made.where(merkle.folded(F.col("leaf")) != F.col("root")).count() == 0
    assert made.where(merkle.folded(F.sha2(F.lit("other"), 256)) == F.col("root")).count() == 0
