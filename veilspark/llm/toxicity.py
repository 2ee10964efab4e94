"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from labelled rows: words far more frequent among toxic
documents.  Each word of a text runs as a Levenshtein automaton against the trie, so
misspelled terms match within one edit.  The words around a match
are its context: quotation marks and learned context weights separate a quoted term
from an abusive one.  A logistic unit turns the matches of a document into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_classifier import held_out, sample_of

#: Labelled rows that lexicon, context and weights are learned from, at most; they alone bound both.
SAMPLE = 10_000
#: Words on each side of a match that are its context; words remembered by a worker.
CONTEXT, CACHE = 6, 2_000_000
#: Length from which a term may be misspelled, and by how many edits.
MISSPELLED, EDITS = 5, 1
QUOTES = "\"“”„«»‹›'‘’"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def edits_allowed(term: str) -> int:
    return EDITS if len(term) >= MISSPELLED else 0


def build_trie(terms: list[str]) -> dict:
    root: dict = {}
    for i, term in enumerate(terms):
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = i
    return root


def intersect(word: str, trie: dict, terms: list[str]) -> tuple[int, int] | None:
    """(term, edits) of the nearest lexicon term that the word's automaton accepts.

    The automaton's state is the row of edit distances between the trie's path and those
    prefixes of the word that are about as long; a path dies when all exceed the most edits.
    """
    best: tuple[int, int] | None = None
    size, over = len(word), EDITS + 1
    band = range(2 * EDITS + 1)  # at depth d, place b stands for the first d - EDITS + b characters
    stack = [(trie, 0, [b - EDITS if b >= EDITS else over for b in band])]
    while stack:
        node, depth, row = stack.pop()
        i = node.get("")
        end = size - depth + EDITS
        if i is not None and end in band and row[end] <= edits_allowed(terms[i]) and (best is None or (row[end], i) < (best[1], best[0])):
            best = (i, row[end])
        for c, child in node.items():
            if c:
                new, left, at = [], over, depth - EDITS
                for b in band:
                    cost = left + 1
                    if 0 <= at < size and row[b] + (word[at] != c) < cost:
                        cost = row[b] + (word[at] != c)
                    if b < 2 * EDITS and row[b + 1] + 1 < cost:
                        cost = row[b + 1] + 1
                    if not -1 <= at < size or cost > over:
                        cost = over
                    new.append(cost)
                    left, at = cost, at + 1
                if min(new) <= EDITS:
                    stack.append((child, depth + 1, new))
    return best


class Lexicon:
    """Terms with weights, context weights, and the unit's coefficients."""

    def __init__(self, terms: list[str], weights: list[float], context: dict[str, float]):
        self.terms, self.weights, self.context = terms, weights, context
        self.coefficients = np.zeros(7)

    def matcher(self):
        """Word -> (term, edits) or None, remembered.

        One edit leaves a term's first or second half whole, so a word that begins with
        no first half and ends with no second half of a term about as long is refused
        before its automaton runs.
        """
        trie, known = build_trie(self.terms), {t: (i, 0) for i, t in enumerate(self.terms)}
        long = [t for t in self.terms if edits_allowed(t)]
        heads, tails = {(len(t), t[: len(t) // 2]) for t in long}, {(len(t), t[len(t) // 2 :]) for t in long}
        terms = dict(known)

        def find(word: str) -> tuple[int, int] | None:
            bare = _EDGES.sub("", word)
            if bare in terms:
                return terms[bare]
            if not any((n, bare[: n // 2]) in heads or (n, bare[n // 2 - n :]) in tails for n in range(len(bare) - EDITS, len(bare) + EDITS + 1)):
                return None
            return intersect(bare, trie, self.terms)

        def match(word: str) -> tuple[int, int] | None:
            if word in known:
                return known[word]
            if len(known) > CACHE:
                known.clear()
            known[word] = found = find(word)
            return found

        return match

    def features(self, text: str | None, match) -> list[float]:
        """Bias, matches outside quotation, matches within it, misspelled ones, strongest, share, context."""
        words = (text or "").lower().split()
        hits = [(i, m) for i, w in enumerate(words) if (m := match(w))]
        open_, quoted, misspelled, strongest, around = 0.0, 0.0, 0.0, 0.0, 0.0
        for i, (term, edits) in hits:
            near = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
            before, after = words[max(0, i - CONTEXT) : i + 1], words[i : i + CONTEXT + 1]
            within = any(w[0] in QUOTES for w in before) and any(w.rstrip(".,;:!?")[-1:] in QUOTES and w.rstrip(".,;:!?") for w in after)
            weight = self.weights[term] / (1 + edits)
            if within:
                quoted += weight
            else:
                open_ += weight
                strongest = max(strongest, weight)
            misspelled += edits > 0
            around += sum(self.context.get(w, 0.0) for w in near) / len(near)
        return [1.0, np.log1p(open_), np.log1p(quoted), np.log1p(misspelled), strongest, 10 * len(hits) / (len(words) + 10), around / max(1, len(hits))]

    def score(self, text: str | None, match) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.coefficients @ np.array(self.features(text, match)), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b = b - np.clip(np.linalg.solve(h, x.T @ (p - y) + ridge * b), -4, 4)
    return b


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Lexicon:
    """Lexicon, context and coefficients from a bounded sample; empty without labelled rows."""
    sample = sample_of(docs, labels, "toxic", bound).where(F.col("text").isNotNull()).distinct()
    word = F.regexp_replace(F.col("w"), r"^[\W_]+|[\W_]+$", "")
    words = sample.select("target", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w")).select("target", word.alias("w")).where(F.length("w") > 1)
    totals = sample.agg(F.sum("target").alias("t"), F.sum(1 - F.col("target")).alias("c")).first()
    toxic, clean = totals.t or 0.0, totals.c or 0.0
    if not toxic:
        return Lexicon([], [], {})
    counts = words.groupBy("w").agg(F.sum("target").alias("t"), F.sum(1 - F.col("target")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    ranked = counts.where(F.col("t") >= max(3.0, 0.01 * toxic)).select("w", "t", "c", odds.alias("odds"))
    terms = ranked.where("odds > 3").orderBy(F.desc("t"), "w").collect()
    context = ranked.where("odds <= 3 AND abs(odds) > 0.3 AND t + c >= 50").orderBy(F.desc(F.abs("odds")), "w").collect()
    lexicon = Lexicon([r.w for r in terms], [float(r.odds) for r in terms], {r.w: float(r.odds) for r in context})

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lexicon.matcher()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([lexicon.features(t, match) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())), "target": batch.column("target")})

    rows = sample.mapInArrow(featurise, "x array<double>, target double").collect()
    rows.sort(key=lambda r: (r.target, r.x))
    lexicon.coefficients = logistic(np.array([r.x for r in rows]), np.array([r.target for r in rows]))
    return lexicon


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts match nothing and get the score of no match; without labelled
    rows every score is 0.5.  Repeated rows repeat their result.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, bound))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lexicon.value.matcher()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array([lexicon.value.score(t, match) for t in batch.column("text").to_pylist()], pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
