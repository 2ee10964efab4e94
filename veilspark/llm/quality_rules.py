"""Host-level quality rules in DataFrame functions only.

Every document is measured by column expressions over its whole text.  The rule
failures are summed by host (the ``source`` column); a host's failure rate is shrunk
towards the corpus by a beta prior fitted to all hosts; the verdict on the host goes
back to its documents by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A host goes when the shrunk rate of its failing documents exceeds this.
HOST_LIMIT = 0.8
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1000.0
WHITE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"


def _longs(c: Column) -> Column:
    return c.cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base measures of every document; null text has no words.

    A 3-word window is known by its 64-bit hash within its own text.  Only texts that
    repeat a window sort their windows to find the words inside.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = docs.select("doc_id", "source", text.alias("_text"))
    kept = kept.withColumn("_words", F.array_remove(F.split("_text", WHITE), ""))
    kept = kept.withColumn("_n", F.size("_words"))
    word = lambda i: F.get(F.col("_words"), i)
    kept = kept.withColumn("_h", F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<bigint>")))
    kept = kept.select(
        "doc_id",
        "source",
        _longs(F.col("_n")).alias("n_words"),
        _longs(F.length(F.array_join("_words", ""))).alias("word_chars"),
        _longs(F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: F.length(F.regexp_replace(x, WHITE, "")) > 0).alias("_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).alias("_h"),
    )
    kept = kept.withColumn("_pairs", F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda x, k: x["h"] == F.get(F.col("_pairs"), k)["h"]
    at = F.filter("_pairs", lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | F.coalesce((k > 0) & same(x, F.greatest(k - 1, F.lit(0))), F.lit(False)))
    kept = kept.withColumn("_at", F.sort_array(F.transform(at, lambda x: x["i"])))
    covered = F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(3))))
    kept = kept.withColumn("_covered", covered)
    n_repeat = F.coalesce(F.aggregate("_covered", F.lit(0), lambda a, x: a + x), F.lit(0))
    return kept.select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", _longs(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), _longs(n_repeat).alias("n_repeat_words")
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rule_failed() -> Column:
    """Any rule: the base ones, symbols above a tenth of the characters, duplicate lines."""
    return F.col("base_failed") | (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > F.col("n_words"))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """source, documents, failures, posterior, host_kept: one row for each host, null too."""
    hosts = measured.groupBy("source").agg(F.count("*").alias("documents"), F.sum(rule_failed().cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("documents")
    prior = hosts.agg(F.sum("failures").alias("_f"), F.sum("documents").alias("_d"), F.sum(rate * F.col("failures")).alias("_q"))
    mean = F.col("_f") / F.col("_d")
    spread = F.col("_q") / F.col("_d") - mean * mean
    strength = F.when(spread > 1e-12, F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), mean * (1 - mean) / spread - 1))).otherwise(F.lit(STRONGEST))
    prior = prior.select(mean.alias("_mean"), strength.alias("_strength"))
    joined = hosts.crossJoin(F.broadcast(prior))  # the prior is one row
    posterior = (F.col("failures") + F.col("_mean") * F.col("_strength")) / (F.col("documents") + F.col("_strength"))
    return joined.select("source", "documents", "failures", posterior.alias("posterior"), (posterior <= HOST_LIMIT).alias("host_kept"))


def apply_rules(docs: DataFrame) -> DataFrame:
    """The measures of every document with base_failed and kept.

    Null and empty texts have no words and fail; documents of a null source form one
    host; an empty table gives none.  Columns besides doc_id, text, source are ignored.
    """
    measured = cut(measure(docs))
    hosts = host_verdicts(measured).select(F.col("source").alias("_source"), "host_kept")
    joined = measured.join(hosts, F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS s FROM d, unnest(range(1, len(w) - 1)) u(k)),
rep AS (SELECT doc_id, k FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \t-\r]') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
 FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > n_words THEN 1 ELSE 0 END) AS f FROM b GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS mean, sum(f / n * f) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least(1000.0, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1000.0 END AS s FROM p),
v AS (SELECT source, (f + mean * s) / (n + s) <= 0.8 AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
