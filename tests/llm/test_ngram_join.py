import random
import re
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from veilspark.llm import ngram_join
from veilspark.llm.common import ensure_checkpoint_dir
from veilspark.llm.components import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def sample(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgÉ") for _ in range(r.randint(2, 6)))
    rows = ["", " \t\n", "one", "ONE", "one two three", "One  two\tthree", None]
    passage = [word() for _ in range(30)]
    for size in (5, 6, 8, 12, 20, 40, 100, 300):
        base = [word() for _ in range(size)]
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, max(1, size // 25))):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w[r.randint(0, 1) :]))
            rows.append(" ".join(w))
        rows += [" ".join([word() for _ in range(size)] + passage) for _ in range(5)]
    rows.append("\x0b".join(word() for _ in range(20_000)))
    return list(enumerate(r.sample(rows, len(rows)), 100))


def test_components_equal_brute_force(spark, monkeypatch):
    rows = sample(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert sorted(map(tuple, ngram_join.near_duplicates(df).collect())) == want
    monkeypatch.setattr(ngram_join, "FAMILY_BYTES", 9000)  # large families are cut by size band
    assert sorted(map(tuple, ngram_join.near_duplicates(df).collect())) == want
    monkeypatch.undo()
    monkeypatch.setattr(ngram_join, "FAMILY_DOCS", 6)
    monkeypatch.setattr(ngram_join, "TILE", 4)
    assert sorted(map(tuple, ngram_join.near_duplicates(df).collect())) == want


def test_a_shingle_in_every_document(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):  # small documents around one passage, some near copies
        w = [f"q{i // 3}x{k}" for k in range(r.randint(1, 9))]
        rows.append((i, " ".join([*w, "this very line stands in all of them today"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.near_duplicates(df).collect())) == brute(rows)


def test_ids_of_any_kind(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [("b", text), ("a", text + " x"), ("c", "other words here"), (None, text)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("b", 26, "a", 2), ("a", 27, "a", 2), ("c", 1, "c", 0), (None, 26, "a", 2)], key=str)


def test_texts_of_one_id(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(30)) for p in "vw")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x")]
    found = {tuple(sorted(map(tuple, ngram_join.near_duplicates(spark.createDataFrame(x, "doc_id long, text string").repartition(n)).collect()))) for x, n in ((rows, 1), (rows[::-1], 3), (rows, 4))}
    assert len(found) == 1


def test_lone_pairs_equal_brute_force(spark):
    r = random.Random(3)
    rows = []
    for size in range(4, 41):
        for pair in range(16):
            w = [f"p{size}x{pair}x{k}" for k in range(size + 4)]
            cut = r.randint(1, max(1, size // 4))
            a = r.randint(0, cut)
            rows += [" ".join(w), " ".join(w[a : len(w) - cut + a])]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, ngram_join.near_duplicates(df).collect())) == brute(rows)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(3, text, "a"), (1, text + " x", "b"), (1, text + " x", "b"), (2, "other words here", "c"), (4, None, None), (None, text, "d"), (5, "", "e")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, family string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5], rows[6]], key=str)


def test_empty_table(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 7), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7, 9: 7}
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).collect() == []


def test_components_of_few_edges_leave_few_files(spark):
    """However many shuffle partitions there are, the rounds write as many files as their edges fill."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    ensure_checkpoint_dir(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    before = set(folder.glob("rdd-*"))
    try:
        for k, v in zip(kept, ("48", "false"), strict=True):
            spark.conf.set(k, v)
        found = components(spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(61)}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    files = sorted(len(list(f.glob("part-*"))) for f in set(folder.glob("rdd-*")) - before)
    assert len(files) > 3 and files[-2] <= 2  # the last one: the edges as they came
