import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import suffix_dedup


def brute(rows, length):
    """Spans covered by a window that starts anywhere else too."""
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in rows:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(b for b, h in zip(t, hit, strict=True) if not h)
        runs = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((doc_id, len(t), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    rows = ["", "a" * 201, "ab" * 150, "x" * 199, prose(300)]
    rows += [prose(r.randint(0, 40)) + r.choice(passages) + prose(r.randint(0, 90)) for _ in range(60)]
    base = prose(200).split(" ")
    for _ in range(25):
        w = list(base)
        w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += rows[5:9]
    period = prose(20)
    return rows + [period * 6, prose(15) + period * 3]


@pytest.mark.parametrize("together", [20_000, 3])
def test_spans_equal_brute_force(spark, together):
    rows = [(i, t) for i, t in enumerate(texts(3))]
    df = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string").repartition(5)
    got = suffix_dedup.digest(df, together=together).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute([(i, t.encode()) for i, t in rows], 200)
    assert [tuple(r)[:4] for r in got if r.doc_id is None] == [(None, 0, 0, 0)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=40), min_size=1, max_size=6), st.integers(3, 6))
def test_longest_previous_factors_equal_brute_force(parts, length):
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    n = len(data)
    ranks = suffix_dedup.prefix_ranks(data, length)
    padded = data.tobytes() + b"\0" * length
    assert [len(set(r.tolist())) for _, r in ranks] == [len({padded[i : i + h] for i in range(n)}) for h, _ in ranks]
    order = np.argsort(ranks[-1][1], kind="stable")
    assert [padded[i : i + length] for i in order] == sorted(padded[i : i + length] for i in range(n))
    common = lambda i, j: next((k for k in range(length) if padded[i + k] != padded[j + k]), length)
    lcp = np.append(0, suffix_dedup.common_prefixes(ranks, order[1:], order[:-1]))
    assert lcp.tolist() == [0] + [common(i, j) for i, j in zip(order[1:], order[:-1])]
    for sign in (1, -1):
        got = suffix_dedup.previous_factors(lcp, sign * order, 1)
        assert got.tolist() == [max((common(i, j) for j in range(n) if sign * j < sign * i), default=0) for i in order]


@pytest.mark.parametrize("together", [20_000, 2])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_a_passage_in_every_document(spark, keep, together):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))[:260]
    rows = [(i, word() + passage + word() * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.digest(df, keep=keep, together=together).collect()}
    if keep == "none":
        want = {d: (removed, runs) for d, _, removed, runs, _ in brute([(i, t.encode()) for i, t in rows], 200)}
        assert got == want
    else:  # bytes under a window that an earlier document, or an earlier place, has too
        seen, want = set(), {}
        for i, t in rows:
            hit = set()
            for k in range(len(t) - 199):
                if t[k : k + 200] in seen:
                    hit |= set(range(k, k + 200))
                seen.add(t[k : k + 200])
            want[i] = len(hit)
        assert {d: n for d, (n, _) in got.items()} == want


def test_first_copy_stays(spark):
    r = random.Random(1)
    passage = "".join(r.choice("abcdefgh") for _ in range(400))
    rows = [(2, "b" * 5 + passage + "tail é", 7, "x"), (1, passage, 400, "y"), (3, "é" + passage, 401, "z"), (3, "é" + passage, 401, "z"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(df).collect()}
    assert got[1].text == passage and got[1].n_chars == 400
    assert got[2].text == "bbbbbtail é" and got[2].n_chars == 11
    assert got[3].text == "é" and got[3].spans == "z" and got[4].text is None


def test_empty_table(spark):
    assert suffix_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
