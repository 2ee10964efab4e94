"""The leak search against brute force, by broadcast and by the index of grams."""

import random

import pytest

from veilspark.operators import gates as G


def brute(texts, values, shortest):
    return sorted(i for i, t in texts if t is not None and any(v is not None and len(v) >= shortest and v in t for v in values))


@pytest.mark.parametrize("limit", [8 << 20, 0])
@pytest.mark.parametrize("shortest", [1, 4])
def test_leaks_equal_brute_force(spark, monkeypatch, limit, shortest):
    monkeypatch.setattr(G, "LEAK_BYTES", limit)
    monkeypatch.setattr(G, "HOT_GRAM", 7)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abAB -@.é中") for _ in range(r.randint(1, 22)))
    values = [None, "", "abc", "Mary Smith-Jones", "a@b.example", "xx" * 40, *(word() for _ in range(60))]
    # a head that all texts share holds every gram of some values
    head = "Licence: all rights of Mary Smith are reserved. "
    texts = [head + word() + r.choice(["", word(), *[v for v in values if v]]) + word() for _ in range(150)]
    texts += [None, "", "Mary Smith-Jones", "x" * 79, "xx" * 40, "é" * 600 + "a@b.example" + "é" * 600]
    rows = list(enumerate(texts))
    got = G.leaks(spark.createDataFrame(rows, "i int, text string").repartition(3), "text", spark.createDataFrame([(v,) for v in values], "v string"), "v", shortest)
    assert sorted(x.i for x in got.collect()) == brute(rows, values, shortest)


def test_a_gram_that_all_texts_share_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(G, "HOT_GRAM", 50)
    texts = spark.range(400).selectExpr("id AS __of", "concat('same head ', CAST(id AS STRING)) AS __text")
    values = spark.createDataFrame([("same",), ("head 7",), ("none of it",)], "raw_value string")
    pairs = G.gram_pairs(texts, values, 4).distinct().collect()
    assert {p.raw_value for p in pairs} == {"same", "head 7"}
    assert sum(p.raw_value == "same" for p in pairs) == 400
    assert sum(p.raw_value == "head 7" for p in pairs) == 11  # texts with "ad 7", the rarest of its grams


def test_all_text_cells_of_all_tables(spark):
    frames = {"a": spark.createDataFrame([("x", 1, "y"), ("x", 2, None)], "one string, two int, `three.of` string"), "b": spark.createDataFrame([("z",)], "four string"), "c": spark.range(2)}
    got = sorted(map(tuple, G.text_cells(frames, ("four",)).collect()))
    assert got == [("a", "one", "x"), ("a", "three.of", "y")]
