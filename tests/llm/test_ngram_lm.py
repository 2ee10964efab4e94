import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.llm import common, ngram_lm


def brute(rows):
    """The same model with dictionaries of words."""
    toks = {d: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"] for d, t in rows}
    train = [toks[d] for d, _ in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    pairs, words, left, after = Counter(), Counter(), Counter(), defaultdict(list)
    for t in train:
        pairs.update(zip(["<s>", *t], t, strict=False))
        words.update(t)
    for (v, w), n in pairs.items():
        left[w] += 1
        after[v].append(n)
    of = lambda c: ngram_lm.discounts(*(sum(1 for n in c.values() if n == k) for k in (1, 2, 3, 4)))
    high, low = of(pairs), of(left)
    total, types = sum(words.values()), len(words)
    spare = sum(low[min(3, n)] for n in left.values())
    out = []
    for d, _ in rows:
        s = 0.0
        for v, w in zip(["<s>", *toks[d]], toks[d], strict=False):
            p = (max(0, left[w] - low[min(3, left[w])]) + spare / (types + 1)) / sum(left.values())
            if after[v]:
                n = pairs[v, w]
                p = (max(0, n - high[min(3, n)]) + sum(high[min(3, k)] for k in after[v]) * p) / sum(after[v])
            s += math.log10(p)
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (types + 1))) for w in toks[d])
        out.append((d, zlib.crc32(str(d).encode()) % 5 == 1, len(toks[d]), sum(1 for w in toks[d] if words[w]), total, base, s))
    return sorted(out)


def test_scores_equal_dictionaries(spark):
    r = np.random.default_rng(1)
    rows = [(i, " ".join(f"W{k}" for k in r.zipf(1.4, r.integers(0, 60)) % 50) + "\n") for i in range(300)] + [(900, None), (901, "é É  x")]
    rows.append((902, "the " * 1000))
    got = sorted(map(tuple, ngram_lm.evaluate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    for g, w in zip(got, brute(rows), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_next_words_sum_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b c a b", "b b a", "c a a b d", "a"])]
    model = ngram_lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    words = [ngram_lm.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in ("a", "b", "c", "d", "never")] + [ngram_lm.END]
    for v in (*words[:4], ngram_lm.START):
        logp, _ = model.score(np.array(words, np.uint64), np.full(6, v, np.uint64))
        assert (10**logp).sum() == pytest.approx(1)


def test_empty_table(spark):
    assert ngram_lm.evaluate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_three(rows):
    """Scores of the model of order three with dictionaries of words."""
    toks = {d: ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "</s>"] for d, t in rows}
    train = [toks[d] for d, _ in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    raw, triples, words = Counter(), Counter(), Counter()
    for t in train:
        raw.update(zip(t, t[1:], strict=False))
        triples.update(zip(t, t[1:], t[2:], strict=False))
        words.update(t[1:])
    pairs, left, after2, after3 = Counter({k: n for k, n in raw.items() if k[0] == "<s>"}), Counter(), defaultdict(list), defaultdict(list)
    for u, v, w in triples:
        pairs[v, w] += 1
        after3[u, v].append(triples[u, v, w])
    for v, w in pairs:
        left[w] += 1
        after2[v].append(pairs[v, w])
    of = lambda c: ngram_lm.discounts(*(sum(1 for n in c.values() if n == k) for k in (1, 2, 3, 4)))
    d3, d2, d1 = of(triples), of(pairs), of(left)
    less = lambda n, d: max(0, n - d[min(3, n)])
    out = {}
    for doc, t in toks.items():
        s = 0.0
        for i in range(1, len(t)):
            v, w = t[i - 1], t[i]
            p = (less(left[w], d1) + sum(d1[min(3, n)] for n in left.values()) / (len(words) + 1)) / sum(left.values())
            if after2[v]:
                p = (less(pairs[v, w], d2) + sum(d2[min(3, n)] for n in after2[v]) * p) / sum(after2[v])
            if i > 1 and after3[t[i - 2], v]:
                seen = after3[t[i - 2], v]
                p = (less(triples[t[i - 2], v, w], d3) + sum(d3[min(3, n)] for n in seen) * p) / sum(seen)
            s += math.log10(p)
        out[doc] = s
    return out


def test_order_three_equals_dictionaries(spark):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}" for k in r.zipf(1.4, r.integers(0, 60)) % 50)) for i in range(300)] + [(900, None), (902, "the " * 1000)]
    got = ngram_lm.evaluate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order=3).collect()
    assert {x.doc_id: x.score for x in got} == pytest.approx(brute_three(rows), rel=1e-9)
    assert ngram_lm.evaluate(spark.createDataFrame([], "doc_id long, text string"), order=3).collect() == []


def test_dealt_words_and_few_mapped_bytes_change_no_score(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in r.zipf(1.3, r.integers(0, 80)) % 90)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(ngram_lm, "SAMPLE", 1.0)
    layout = ngram_lm.layout_of(docs.select("text"), 12, 3)
    assert 1 < len(layout.dealt) <= 13 and layout.parts.max() > 1
    dealt = {x.doc_id: x.score for x in ngram_lm.evaluate(docs, order=3).collect()}
    start = ngram_lm.Layout(12, np.array([ngram_lm.START]), np.array([1], np.uint64))
    monkeypatch.setattr(ngram_lm, "layout_of", lambda *_: start)
    plain = {x.doc_id: x.score for x in ngram_lm.evaluate(docs, order=3).collect()}
    assert dealt == pytest.approx(brute_three(rows), rel=1e-9) and plain == pytest.approx(dealt, rel=1e-12)


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_table_gives_back_its_rows(tmp_path, n):
    r = np.random.default_rng(n)
    key = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    values = r.choice(np.array([0, 1, 1, 1, 7, 300, 2**40], np.uint64), (len(key), 4))
    values[: n // 2] = ngram_lm.USUAL["context"]
    values[values.sum(axis=1) == 0, 0] = 2
    ngram_lm.write_table(f"file://{tmp_path}", "context", 3, key[::-1], values[::-1])
    table = ngram_lm.Table(str(tmp_path / "context-3"), 4)
    asked = np.concatenate([key, r.integers(0, 2**64, 50, dtype=np.uint64)])
    got = table.rows(asked, ngram_lm.USUAL["context"])
    assert (got[: len(key)] == values).all() and not got[len(key) :].any()


def test_many_types_are_sorted_like_few():
    r = np.random.default_rng(5)
    rows = r.integers(0, 20, (3, 2000)).astype(np.uint64)
    n = np.ones(2000, np.uint64)
    for a, b in zip(ngram_lm.sorted_triples(*rows, n, 20), ngram_lm.sorted_triples(*rows, n, 1 << 22), strict=True):
        assert (a == b).all()


def test_merged_counts_above_32_bits_stay_whole():
    n = np.array([2**33 + 5, 7], np.uint64)
    word, before = np.array([1 << 20, 5 << 20], np.uint64), np.full(2, 9 << 20, np.uint64)
    (_, blob), = ngram_lm.pack_endings(before, word, n, n * np.uint64(3), 1)
    got = common.unpack(blob, **ngram_lm.ENDING)
    assert sorted(got["n"].tolist()) == sorted(n.tolist()) and sorted(got["tokens"].tolist()) == sorted((3 * n).tolist())
    words = ngram_lm.about_words(before, word, n, n * np.uint64(3))
    back = ngram_lm.merged_words([b for _, b in ngram_lm.send_words(words, 1)])
    assert back["total"].max() == 2**33 + 12 and back["count"].max() == 3 * (2**33 + 5)


def test_a_lost_file_is_an_error(spark):
    import glob
    import os

    docs = spark.createDataFrame([(i, f"one two three w{i}") for i in range(40)], "doc_id long, text string")
    model = ngram_lm.fit(docs, 3)
    assert model.folder.startswith("file:///")
    found = sorted(os.path.basename(f) for f in glob.glob(f"{model.folder.removeprefix('file://')}/*"))
    assert found == sorted(f"{t}-{s}" for t in ngram_lm.USUAL for s in range(model.layout.shards))
    want = ngram_lm.score(docs, model).count()
    assert want == 40
    for name in found:
        if name.startswith("word-"):
            os.rename(f"{model.folder.removeprefix('file://')}/{name}", f"{model.folder.removeprefix('file://')}/gone-{name}")
    with pytest.raises(Exception, match="No such file"):
        ngram_lm.score(docs, model).collect()


def test_odd_rows_of_the_language_model(spark):
    rows = [(1, "a b a", 1, "x"), (1, "a b a", 1, "x"), (None, "b c", None, None), (None, None, 2, "y"), (4, "", 3, None), (5, "zz " * 5000, 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, `score.of` string")
    got = ngram_lm.evaluate(docs, order=3).collect()
    assert len(got) == 6
    plain = {(x.doc_id, x.n_tokens): round(x.score, 9) for x in ngram_lm.evaluate(docs.select("doc_id", "text"), order=3).collect()}
    assert {(x.doc_id, x.n_tokens): round(x.score, 9) for x in got} == plain
    assert sum(x.doc_id == 1 for x in got) == 2 and {x.n_tokens for x in got if x.doc_id is None} == {3, 1}
