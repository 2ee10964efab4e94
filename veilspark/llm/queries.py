"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, fill_middle, merge_dropout, merkle, ngram_join, ngram_lm, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, toxicity
from .common import documents


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.split(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return merge_dropout.round_trip(documents(spark, sf_dir), str(public_tokenizers.path("piece_bpe_32k.model")), seed=7)


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.evaluate(documents(spark, sf_dir), order=3)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(documents(spark, sf_dir), seed=42)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digest(documents(spark, sf_dir), str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_sharding, op3_quality_rules, op4_decontaminate, op5_quality_classifier, op6_toxicity, op7_sentencepiece, op8_ngram_lm, op9_token_counts, op10_suffix_dedup, op11_fill_in_middle, op12_byte_bpe, op13_merkle_manifest)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 5) - 1], ' ') AS g FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) u(k) WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * i >= 75 * (cx.n + cy.n - i)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, m.component_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = d.doc_id JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
""",
    "op3_quality_rules": quality_rules.SQL,
    "op4_decontaminate": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s FROM i, unnest(range(1, greatest(1, len(w) - 9) + 1)) u(k) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM iw) x, unnest(range(1, len(w) - n + 2)) u(k)),
hits AS (SELECT dw.doc_id, dw.k, dw.n, iw.item FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
""",
    "op11_fill_in_middle": fill_middle.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
