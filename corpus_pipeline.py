"""From raw documents to training tokens in five stages.

Each stage takes what its predecessor kept and is written as Parquet in the shared
folder before the next one reads it, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, merge_dropout, ngram_join, quality_classifier, suffix_dedup
from veilspark.llm.common import documents, ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage-attention classifier rejects go.

    Null and empty texts are scored as one empty passage; repeated rows fare alike; ids
    may be null; all columns stay.  Without labelled rows every document stays.
    """
    return quality_classifier.keep_good(docs, documents(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of the n-gram Jaccard join stays: the one whose id names it.

    Null and empty texts and rows of a null id stay; of repeated rows of one id one stays.
    """
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 200 bytes are cut; the first, by id and position, stays.

    Null and short texts pass unchanged; rows of one id and text count as one document.
    """
    return suffix_dedup.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all words of a shorter one, go whole.

    An item of one word takes every document with that word.  Null and empty texts stay.
    """
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids: the pieces of every remaining text, which decode without loss; none for a null text."""
    import public_tokenizers

    encoded = merge_dropout.encode(docs, str(public_tokenizers.path("piece_bpe_32k.model")), seed=7)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Learned weights and hashed segmentations are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
