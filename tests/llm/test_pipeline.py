import random
import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from veilspark.llm import merge_dropout

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(2)
    folder = str(tmp_path_factory.mktemp("tables"))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 8)))
    prose = lambda n: (" ".join(word() for _ in range(n)) + ".").capitalize()
    junk = lambda n: " ".join(word().upper() + "!!" for _ in range(n))
    passage, item = prose(60), prose(25)
    texts = {i: prose(90) for i in range(60)}
    texts |= {100 + i: junk(80) for i in range(30)}
    texts |= {200 + i: prose(30) + " " + passage + " " + prose(40) for i in range(4)}
    texts |= {300: prose(40) + " " + item + " " + prose(30), 301: texts[5], 302: texts[6] + " " + word(), 303: None, 304: ""}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 130)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, passage


def test_every_stage_takes_effect(spark, tables):
    folder, texts, passage = tables
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        docs = docs.cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(60))
    assert clean <= set(kept["quality"]) and not set(range(100, 130)) & set(kept["quality"])
    near = kept["near_duplicates"]
    assert set(kept["quality"]) - set(near) == {301, 302}
    ids = [i for i in near if near[i].text]
    for a in ids:
        for b in ids:
            if a < b:
                x, y = grams(near[a].text), grams(near[b].text)
                assert 100 * len(x & y) < 75 * len(x | y)
    once = kept["repeated_passages"]
    assert [i for i in (200, 201, 202, 203) if passage in once[i].text] == [200]
    assert all(once[i].text == texts[i] for i in clean) and all(once[i].n_chars == len(once[i].text or "") for i in once)
    assert set(once) - set(kept["benchmark_leaks"]) == {300}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    codec = merge_dropout.Codec(str(public_tokenizers.path("piece_bpe_32k.model")))
    assert {i: codec.decode(np.array(r.ids, np.int64)).decode() for i, r in out.items()} == {i: r.text or "" for i, r in kept["benchmark_leaks"].items()}


def test_stages_take_odd_tables(spark, tables, tmp_path):
    """Null ids and texts, repeated rows, extra columns with clashing and dotted names, and no rows at all."""
    folder = tables[0]
    odd = DOCUMENTS + ", family string, spans int, `extra.of` string, one int"
    long = " ".join(f"word{i % 97}x{i}" for i in range(300))
    rows = [(i, t, "en", "s", None if t is None else len(t), "f", 1, "e", 2) for i, t in enumerate([None, "", "a short text", long, long + " end", long])]
    rows += [rows[3], rows[2], rows[0], (None, long, None, None, None, None, None, None, None), (None,) * 9]
    for docs in (spark.createDataFrame(rows, odd), spark.createDataFrame([], odd)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder).cache()
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "family", "spans", "extra.of", "one"]
            docs.count()
        out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert len(out) == docs.count()


def test_run_on_an_empty_and_a_repeated_table(spark, tables):
    folder, texts, _ = tables
    for name, rows in (("none", []), ("twice", [(i, t, "en", "s", len(t or "")) for i, t in list(texts.items())[:20]] * 2)):
        spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/{name}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{folder}/{other}.parquet").write.parquet(f"{folder}/{name}/{other}.parquet")
        out = corpus_pipeline.run(spark, f"{folder}/{name}").collect()
        assert sorted(r.doc_id for r in out) == sorted({r[0] for r in rows})
