"""Operators on small fixtures: brute force, exact round trips, and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import common, decontaminate, merge_dropout, quality_classifier, quality_rules, sharding, token_counts, toxicity

ODD = "doc_id long, text string, source string, size int, key string, shard string, score string, label string, n_words string"
BPE, PIECES = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    r = random.Random(4)
    texts = [None, "", " ", "word", "A b\nA b\n\n", "x " * 30_000, "é" * 5000, "tie tie tie", "tie tie tie", "<|endoftext|> a<|endoftext|>", "▁ \0 ▁▁ a"]
    texts += [" ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(r.randint(1, 90))) for _ in range(40)]
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", None, "k", None, "z", None, "w") for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[12], (None, "no id here", "s1", 1, None, "q", None, "l", None), (None,) * 9]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2, "x") for i in range(50)] + [(None, 1, 1, None), (3, None, None, None)], "doc_id long, quality int, toxic int, text string")


def empty(df):
    return df.limit(0)


# Sharding


def test_shards_are_even_and_slots_gapless(spark):
    r = random.Random(1)
    rows = [(i, "same text of a hot group" if i % 3 == 0 else "x" * r.randint(0, 400)) for i in range(6000)]
    got = sharding.split(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted((g.doc_id, g.size, g.text_crc32) for g in got) == sorted((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    total = sum(g.size for g in got)
    for s in range(8):
        mine = [g for g in got if g.shard == s]
        assert abs(sum(g.size for g in mine) - total / 8) < 0.01 * total
        assert sorted(g.slot for g in mine) == list(range(len(mine)))


def test_shards_of_odd_rows(odd):
    got = sharding.split(odd).collect()
    assert len(got) == odd.count() and min(g.size for g in got) == 1
    assert sharding.split(empty(odd)).collect() == []


# Quality rules


def test_measures_equal_brute_force(odd):
    def brute(text):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen: dict = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        cover = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)

    got = quality_rules.apply_rules(odd).collect()
    assert len(got) == odd.count()
    texts = {r[0]: r[1] for r in odd_rows()}
    for g in got:
        if g.doc_id is not None:
            want = brute(texts[g.doc_id])
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
            assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (g.kept and g.base_failed)
    assert quality_rules.apply_rules(empty(odd)).collect() == []


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad " * 60, "junk") for i in range(200)] + [(1000 + i, good, "junk") for i in range(4)] + [(2000 + i, good, "fine") for i in range(400)] + [(3000, "bad " * 60, "tiny"), (3001, good, "tiny")]
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(200)) and not got[1000] and got[2000] and got[3001]


def test_rules_stay_in_the_jvm(odd):
    plan = quality_rules.measure(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Benchmark decontamination


def test_windows_and_offsets(spark):
    item = "One two, three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(7, item), (8, "Short one"), (9, None), (10, "..."), (None, item)], "item_id long, text string")
    rows = [(1, "é: " + item.upper().replace(" ", " - ") + " end"), (2, "a SHORT-ONE! and short one"), (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (6, "xone two three four five six seven eight nine tenx")]
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got[1].items == ["7"] and [tuple(s)[:2] for s in got[1].spans] == [(1, 13)]
    raw = rows[0][1].encode()[got[1].spans[0].start_byte : got[1].spans[0].end_byte].decode()
    assert raw.startswith("ONE") and raw.endswith("TWELVE")
    assert got[2].items == ["8"] and [tuple(s)[:2] for s in got[2].spans] == [(1, 3), (4, 6)]
    assert all(not got[i].spans for i in (3, 4, 5, 6))
    d = {r.doc_id: r for r in decontaminate.digest(decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench)).collect()}
    assert (d[2].n_hit, d[2].n_items, d[2].contaminated) == (4, 1, True) and d[2].items_sha256 == hashlib.sha256(b"8").hexdigest()
    assert d[4].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_rounds_equal_one_automaton(spark, odd):
    bench = odd.select(F.col("doc_id").alias("item_id"), "text").where("doc_id between 20 and 30 or doc_id is null")
    assert len(list(decontaminate.rounds(bench, limit=2000))) > 2
    rows = lambda df: sorted(map(str, df.collect()))
    for change in (lambda d: d, lambda d: d.limit(0)):
        whole, parts = (decontaminate.contamination(change(odd), bench, limit=n) for n in (1 << 23, 2000))
        assert rows(whole) == rows(parts) and whole.columns == parts.columns
    assert decontaminate.contamination(odd, bench).count() == odd.count()
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.where("doc_id between 20 and 30").count() == 0
    assert rows(kept) == rows(decontaminate.drop_contaminated(odd, bench, limit=2000))
    assert decontaminate.drop_contaminated(odd, empty(bench)).count() == odd.count()


def test_an_item_without_id_hits_unnamed(spark):
    bench = spark.createDataFrame([(None, "alpha beta"), (5, "gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "an alpha beta"), (2, "alpha beta gamma"), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.digest(decontaminate.contamination(docs, bench)).collect()}
    assert got == {1: (2, 0, True), 2: (3, 1, True), 3: (0, 0, False)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]


# Classifiers


def test_classifiers_on_odd_rows(odd, labels):
    for classify, threshold in ((quality_classifier.classify, 0.3), (toxicity.classify, 0.5)):
        got = classify(odd, labels).collect()
        assert len(got) == odd.count()
        assert all(0 <= g.score <= 1 and g.predicted == (g.score >= threshold) for g in got)
        assert {g.held_out for g in got if g.doc_id == 4} == {zlib.crc32(b"4") % 5 == 0}
        assert {g.score for g in classify(odd, empty(labels)).collect()} == {0.5}
        assert classify(empty(odd), labels).collect() == []
    kept = quality_classifier.keep_good(odd, labels, threshold=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_attention_score_equals_brute_force():
    import pyarrow as pa

    r = random.Random(2)
    texts = ["", "one", " ".join(f"w{r.randint(0, 50)}" for _ in range(200)), "x! " * 64 + "y"]
    x, count = quality_classifier.passages(*common.flat(pa.array(texts)))
    assert count.tolist() == [1, 1, 4, 2]
    words = texts[2].split()
    assert x[2:6, quality_classifier.N_RATIOS :].astype(bool).sum(1).tolist() <= [len(set(words[i : i + 64])) for i in range(0, 200, 64)]
    assert np.allclose((x[1:, quality_classifier.N_RATIOS :] ** 2).sum(1), 1)
    model = quality_classifier.Model(x.mean(0), x.std(0) + 1e-3, seed=3)
    model.p["b"] += 0.1
    p, want, at = model.p, [], 0
    for n in count:
        z = [np.tanh((np.clip((row - model.mean) / model.scale, -6, 6) * model.share) @ p["W"] + p["b"]) for row in x[at : at + n]]
        e = [np.exp(float(((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"])[0])) for v in z]
        m = sum(a / sum(e) * v for a, v in zip(e, z))
        want.append(1 / (1 + np.exp(-float((m @ p["c"] + p["d"])[0]))))
        at += n
    assert model.forward(x, count)[0] == pytest.approx(want)


def test_toxic_features_equal_brute_force():
    lexicon = toxicity.Lexicon(["villain", "rogue", "bad"], [2.0, 1.0, 4.0], {"you": 0.5, "they": -1.0})
    text = "you vilain and they said \"the rogue, he\" was bad; badd is fine"
    found = []
    words = text.lower().split()
    for i, w in enumerate(words):
        bare = w.strip("\",;.")
        near = [(edits(bare, t), k) for k, t in enumerate(lexicon.terms) if edits(bare, t) <= toxicity.edits_allowed(t)]
        if near:
            found.append((i, *min(near)))
    assert [(i, e) for i, e, _ in found] == [(1, 1), (6, 0), (9, 0)]
    weights = [lexicon.weights[k] / (1 + e) for _, e, k in found]
    around = [np.mean([lexicon.context.get(w, 0.0) for w in words[max(0, i - 6) : i + 7]]) for i, _, _ in found]
    want = [1, np.log1p(weights[0] + weights[2]), np.log1p(weights[1]), np.log1p(1), 4.0, 30 / (len(words) + 10), np.mean(around)]
    assert lexicon.features(text, lexicon.matcher()) == pytest.approx(want)
    lexicon.coefficients = np.arange(7) / 10 - 0.3
    assert lexicon.score(text, lexicon.matcher()) == pytest.approx(1 / (1 + np.exp(-float(lexicon.coefficients @ want))))


def test_attention_gradient():
    r = np.random.default_rng(0)
    model = quality_classifier.Model(np.zeros(5), np.ones(5))
    x, count, target = r.normal(size=(9, 5)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    y, kept = model.forward(x, count)
    gradient = model.backward(y, target, kept)
    loss = lambda: -np.mean(target * np.log(model.forward(x, count)[0]) + (1 - target) * np.log(1 - model.forward(x, count)[0]))
    for name, g in gradient.items():
        at = tuple(0 for _ in g.shape)
        model.p[name][at] += 1e-6
        up = loss()
        model.p[name][at] -= 2e-6
        down = loss()
        model.p[name][at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-6)


def test_held_out_quality(spark):
    r = random.Random(3)
    good = lambda: " ".join("".join(r.choice("aeiourstln") for _ in range(r.randint(2, 9))) for _ in range(r.randint(20, 300))) + "."
    bad = lambda: " ".join(w + "$$$" for w in good().split())
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    got = quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string"), lab).where("held_out").collect()
    assert len(got) > 30 and sum(g.predicted == int(g.doc_id % 3 > 0) for g in got) >= 0.97 * len(got)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=8), min_size=1, max_size=6, unique=True), st.text("abcd", max_size=9))
def test_automaton_equals_edit_distance(terms, word):
    lexicon = toxicity.Lexicon(terms, [1.0] * len(terms), {})
    reach = [(edits(word, t), i) for i, t in enumerate(terms) if edits(word, t) <= toxicity.edits_allowed(t)]
    want = min(reach, default=None)
    got = lexicon.matcher()(word)
    assert got == ((want[1], want[0]) if want and len(word) > 1 else ((terms.index(word), 0) if word in terms else None))


def test_quoted_terms_weigh_less(spark):
    r = random.Random(5)
    prose = lambda n: [r.choice("the of and in it was for on are with".split()) + r.choice("abcdef") for _ in range(n)]
    rows = []
    for i in range(300):
        w = prose(40)
        if i % 3 == 0:
            w[20] = r.choice(["villain", "vi11ain", "villan"]) if i % 2 else "villain"
        elif i % 3 == 1 and i % 2:
            w[18:22] = ['"you', "villain", "there", 'sir"']
        rows.append((i, " ".join(w)))
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {g.doc_id: g for g in toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), lab).collect()}
    mean = lambda keep: np.mean([g.score for i, g in got.items() if keep(i)])
    assert mean(lambda i: i % 3 == 0 and i % 2 == 0) > 0.5 > mean(lambda i: i % 3 == 1)


# Tokenizers


def test_token_counts_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    got = token_counts.count_tokens(odd, BPE, limit=100).collect()
    assert len(got) == odd.count()
    for g in got:
        if g.doc_id is not None:
            n = len(t.encode(texts[g.doc_id], add_special_tokens=False).ids)
            assert (g.n_bytes, g.n_tokens, g.over_limit) == (len(texts[g.doc_id].encode()), n, n > 100)
    assert token_counts.count_tokens(empty(odd), BPE).collect() == []


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ▁\0\n<|>endoftx'sre")), max_size=60), st.integers(0, 9))
def test_texts_survive(text, seed):
    c = merge_dropout.codec(PIECES, seed, 0.3)
    ids = c.encode(text, seed)
    assert c.decode(ids) == text.encode()
    assert ids.tolist() == merge_dropout.Codec(PIECES, seed, 0.3).encode(text, seed).tolist() if seed == 0 else True


@pytest.fixture(scope="module")
def kinds():
    return token_counts.classes(BPE)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\t\u3000<|endoftx>'sremdlvS1!é")), max_size=40), min_size=1, max_size=5))
def test_pre_tokens_equal_the_library(kinds, texts):
    import pyarrow as pa

    t = token_counts.tokenizer(BPE)
    cut = token_counts.Cut(pa.array(texts, pa.string()), BPE, kinds)
    if not cut.special.any():
        want = [[span for _, span in t.pre_tokenizer.pre_tokenize_str(x)] for x in texts]
        assert np.bincount(cut.of, minlength=len(texts)).tolist() == [len(w) for w in want]
        assert (cut.end - cut.start).tolist() == [b - a for w in want for a, b in w]
    table = token_counts.Table(cut.hashes[:0], np.zeros(0, np.int64))
    n = cut.special + np.bincount(cut.of, token_counts.lengths(cut, table, BPE), len(texts)).astype(np.int64)
    assert n.tolist() == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 2**64 - 1), unique=True, max_size=200), st.integers(0, 63))
def test_open_addresses_find_what_was_put(hashes, shift):
    keys = np.unique(np.array(hashes, np.uint64) | np.uint64(1) << np.uint64(shift))  # many share their place
    table = token_counts.Table(keys, np.arange(len(keys)) + 1)
    assert table.find(keys).tolist() == list(range(1, len(keys) + 1))
    other = np.setdiff1d(np.array([5, 7, 2**63], np.uint64), keys)
    assert (table.find(other) == -1).all()


def naive(c, text, key):
    """Merge-dropout by its definition: strings, one pair at a time, a set of skipped offers."""
    mask = 2**64 - 1

    def scramble(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * by) & mask
        return x ^ (x >> 31)

    rank = {p: r for r, p in enumerate(c.character) if p in c.id}
    first, out = scramble((key * 0x9E3779B97F4A7C15 + c.seed) & mask), []
    for place, chunk in enumerate(re.findall(" *[^ ]+| +", text), 1):
        own = scramble((first + place * 0xD1342543DE82EF95) & mask)
        parts = [(i, {" ": "▁", "▁": "\0▁"}.get(x, x)) for i, x in enumerate(chunk)]
        skipped = set()
        while True:
            offers = [(rank[a + b], i, k) for k, ((i, a), (_, b)) in enumerate(zip(parts, parts[1:])) if a + b in rank and (i, a + b) not in skipped]
            if not offers:
                break
            r, i, k = min(offers)
            if scramble((own + r * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F) & mask) < c.limit:
                skipped.add((i, parts[k][1] + parts[k + 1][1]))
            else:
                parts[k : k + 2] = [(i, parts[k][1] + parts[k + 1][1])]
        for _, p in parts:
            out += [c.id[p]] if p in c.id else [c.bytes_id[x] for x in (p[1:] if len(p) > 1 else p).encode()]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("abcdetionrs▁ É\0日"), max_size=70), st.text(st.sampled_from("tionhea▁\0"), min_size=45, max_size=120)), max_size=5), st.integers(0, 2**63))
def test_merges_equal_brute_force(texts, key):
    c = merge_dropout.codec(PIECES, 5, 0.3)
    ids, at = c.encode_all(texts, [key + i for i in range(len(texts))])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [naive(c, t, key + i) for i, t in enumerate(texts)]


def test_no_dropout_is_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    m, c = SentencePieceProcessor(model_file=PIECES), merge_dropout.Codec(PIECES, 0, 0.0)
    for text in ("the quick brown fox jumps", "naïve café zu Hause", "unbelievable tokenization 12345"):
        assert c.encode(" " + text).tolist() == m.encode(text)


def test_dropout_varies_and_decodes(spark, odd):
    got = merge_dropout.round_trip(odd, PIECES, seed=1).collect()
    assert len(got) == odd.count() and all(g.lossless for g in got)
    again = merge_dropout.round_trip(odd.repartition(5), PIECES, seed=1).collect()
    digest = lambda rows: sorted((str(r.doc_id), r.n_bytes, r.ids_sha256) for r in rows)
    assert digest(got) == digest(again) != digest(merge_dropout.round_trip(odd, PIECES, seed=2).collect())
    back = merge_dropout.decode(merge_dropout.encode(odd, PIECES, seed=1), PIECES)
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    assert all(r.text == texts[r.doc_id] for r in back.collect() if r.doc_id is not None)
    assert merge_dropout.round_trip(empty(odd), PIECES).collect() == []


# Shared helpers


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab É\t\n\x0b", max_size=12), max_size=8))
def test_words_of_flat_buffers(texts):
    import pyarrow as pa

    data, off = common.flat(pa.array([*texts, None], pa.string()))
    w = common.Words(data, off, common.SPACE)
    found = [bytes(data[a:b]) for a, b in zip(w.start, w.end, strict=True)]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    assert found == [x for t in want for x in t] and w.count.tolist() == [*(len(t) for t in want), 0]
    h = w.hashes()
    assert len(set(h.tolist())) == len({x.lower() for x in found})
    blob = common.pack(key=np.sort(h), x=np.arange(len(h), dtype=np.uint32))
    back = common.unpack(blob, key="uint64", x="uint32")
    assert (back["key"] == np.sort(h)).all() and (back["x"] == np.arange(len(h))).all()


def test_every_occurrence_draws_its_own_merges():
    c = merge_dropout.Codec(PIECES, 3, 0.3)
    word, n = " internationalisation", 400
    text = word * n
    ids, found, at = c.encode(text, 1), [], 0
    while at < len(ids):  # cut back into words
        size, end = 0, at
        while size < len(word):
            size += int(c.length[ids[end]])
            end += 1
        found.append(tuple(ids[at:end].tolist()))
        at = end
    assert len(found) == n and len(set(found)) > 20
    assert found[:-4] != found[4:]
    assert c.decode(ids) == text.encode()


def test_passages_of_a_text_do_not_depend_on_its_neighbours():
    def features(texts):
        return quality_classifier.passages(*common.flat(pa.array(texts)))

    texts = ["a b\n\n\n\n", "c d", "\n\ne f\n", "", "g\nh"]
    together, count = features(texts)
    bounds = np.append(0, np.cumsum(count))
    for k, text in enumerate(texts):
        alone, n = features([text])
        assert n[0] == count[k] and np.allclose(alone, together[bounds[k] : bounds[k + 1]])


def test_learning_takes_one_text_and_one_label_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (3, None)] + [(4, "d")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    kept = [i for i in (1, 2, 3, 4) if zlib.crc32(str(i).encode()) % 5]
    want = {1: ("a", 1.0), 2: ("c", 0.0), 3: (None, 1.0), 4: ("d", 0.0)}
    got = quality_classifier.sample_of(docs, labels, "quality", 10).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((want[i] for i in kept), key=repr)
    assert quality_classifier.sample_of(docs, labels, "quality", 1).count() == 1
