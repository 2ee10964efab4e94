"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of 64 words.  Every passage becomes a vector of its words,
counted by hash, and of counts and ratios; an encoder maps it to a hidden vector, gated attention learned from the
document labels weights the passages, and a logistic unit scores the weighted sum.
Features and scores are computed in Spark tasks over every whole text; the weights are
fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U, Words, flat, map_whole, mix, slices, windows

#: Words of a passage; labelled rows that the weights are fitted on, at most.
PASSAGE, SAMPLE = 64, 6000
#: Passages of one labelled text that the weights are fitted on, at most, evenly spaced; scores take all passages.
PASSAGES_TO_FIT = 1024
HIDDEN, GATE, EPOCHS, BATCH, RATE = 24, 12, 40, 256, 0.01

_MARKS = b"#*$%&|<>!?.,;:()[]{}@/\\=+-_~^'\"`"
_CLASSES = [np.isin(np.arange(256), list(m)) for m in (b"#*$%&", b"|<>", b"!", b"?", b".", b",", b"0123456789", bytes(range(65, 91)), bytes(range(128, 256)), _MARKS)]
N_RATIOS = len(_CLASSES) + 10
#: Places that the words of a passage are counted in, by hash; their share of a passage's vector, and the decay of their weights.
BUCKETS, SHARE, DECAY = 128, 0.25, 0.05
N_FEATURES = N_RATIOS + BUCKETS


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages of every document); a document without words has one empty passage."""
    w = Words(data, off, SPACE)
    count = np.maximum(1, -(-w.count // PASSAGE))
    first_passage = np.append(0, np.cumsum(count))
    out = np.zeros((first_passage[-1], N_FEATURES))
    n = len(w.start)
    if n:
        doc = np.repeat(np.arange(len(w.count)), w.count)
        place = np.arange(n) - w.at[doc]
        at = first_passage[doc] + place // PASSAGE
        size = np.bincount(at, minlength=len(out))
        length = (w.end - w.start).astype(float)
        bytes_ = np.bincount(at, weights=length, minlength=len(out))
        full = size > 0
        for k, of in enumerate(_CLASSES):
            sums = np.append(0, np.cumsum(of[data]))
            per_word = (sums[w.end] - sums[w.start]).astype(float)
            out[full, k] = np.bincount(at, weights=per_word, minlength=len(out))[full] / bytes_[full]
            if k == 7:
                letters = np.append(0, np.cumsum(((np.arange(256) | 32) >= 97)[data] & ((np.arange(256) | 32) <= 122)[data] | (data >= 128)))
                capital = (per_word > 1) & (per_word >= (letters[w.end] - letters[w.start]) * 0.7)
            if k == len(_CLASSES) - 1:
                marked = per_word >= 2
        h = w.hashes()
        same = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
        order = np.lexsort((h, at))
        again = np.zeros(n, bool)
        again[order[1:]] = (h[order][1:] == h[order][:-1]) & (at[order][1:] == at[order][:-1])
        tri = np.zeros(n, bool)
        if n >= 3:
            h3 = mix(windows(h, 3) + doc[:-2].astype(U) * U(0x9E3779B97F4A7C15))
            inside = doc[2:] == doc[:-2]
            _, which, times = np.unique(h3, return_inverse=True, return_counts=True)
            tri[:-2] = inside & (times[which] > 1)
        white = np.append(0, np.cumsum(data == 10))
        line = white[w.start] - white[np.maximum(np.append(0, w.end[:-1]), off[doc])]  # since the word before in the same text
        for k, v in enumerate((length / 10, length > 14, length <= 2, capital, marked, same, again, tri, line)):
            out[full, len(_CLASSES) + k] = np.bincount(at, weights=v.astype(float), minlength=len(out))[full] / size[full]
        out[:, N_RATIOS - 1] = size / PASSAGE
        bucket = (mix(h ^ U(0xA0761D6478BD642F)) % U(BUCKETS)).astype(np.int64)
        counts = np.bincount(at * BUCKETS + bucket, minlength=len(out) * BUCKETS).reshape(-1, BUCKETS)
        out[full, N_RATIOS:] = np.sqrt(counts[full] / size[full, None])
    return out, count


class Model:
    """Encoder, gated attention and output weights, with forward and backward passes over bags."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 0):
        r = np.random.default_rng(seed)
        draw = lambda a, b: r.normal(0, a**-0.5, (a, b))
        self.mean, self.scale = mean, scale
        self.share = np.where(np.arange(len(mean)) < N_RATIOS, 1.0, SHARE)
        self.p = {"W": draw(len(mean), HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1), "c": draw(HIDDEN, 1), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, count: np.ndarray):
        p, first = self.p, np.append(0, np.cumsum(count))[:-1]
        bag = np.repeat(np.arange(len(count)), count)
        x = np.clip((x - self.mean) / self.scale, -6, 6) * self.share
        z = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(z @ p["V"]), 1 / (1 + np.exp(-(z @ p["U"])))
        e = np.exp(np.clip((t * s) @ p["w"], -30, 30))
        a = e / np.add.reduceat(e, first)[bag]
        m = np.add.reduceat(a * z, first)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))
        return y[:, 0], (x, bag, first, z, t, s, a, m)

    def backward(self, y: np.ndarray, target: np.ndarray, kept) -> dict[str, np.ndarray]:
        p, (x, bag, first, z, t, s, a, m) = self.p, kept
        g = ((y - target) / len(y))[:, None]
        dm = g @ p["c"].T
        da = (dm[bag] * z).sum(1, keepdims=True)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dts = de @ p["w"].T
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dz = (a * dm[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - z * z)
        return {"W": x.T @ dz, "b": dz.sum(0), "V": z.T @ dt, "U": z.T @ ds, "w": (t * s).T @ de, "c": m.T @ g, "d": g.sum(0)}


def fit(x: np.ndarray, count: np.ndarray, target: np.ndarray, seed: int = 0) -> Model:
    """Adam on shuffled batches of bags; the classes weigh as they come, and weights of words start at none and decay."""
    model = Model(x.mean(0), x.std(0) + 1e-3, seed)
    model.p["W"][N_RATIOS:] = 0
    first = np.append(0, np.cumsum(count))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    r, step = np.random.default_rng(seed), 0
    for _ in range(EPOCHS):
        order = r.permutation(len(count))
        for i in range(0, len(order), BATCH):
            bags = order[i : i + BATCH]
            y, kept = model.forward(np.concatenate([x[first[b] : first[b + 1]] for b in bags]), count[bags])
            step += 1
            for k, g in model.backward(y, target[bags], kept).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                if k == "W":
                    model.p[k][N_RATIOS:] *= 1 - DECAY
                model.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + RATE * 1e-4 * model.p[k]
    return model


def held_out() -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """text and label of at most ``bound`` labelled rows outside the held-out part, in hash order.

    An id that is labelled several times has its largest label; of several texts of one
    id the first by UTF-8 order is taken, null texts last.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("target"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``bound`` ids
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("target").alias("target")).select("text", "target")


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model | None:
    """The model fitted on the sample, of at most ``bound`` texts and PASSAGES_TO_FIT passages each; None where there is no labelled row."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, count = passages(*flat(part.column("text")))
                bounds = np.append(0, np.cumsum(count))
                yield pa.RecordBatch.from_pydict({"x": pa.array([x[a : b : -(-(b - a) // PASSAGES_TO_FIT)].astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), "target": part.column("target")})

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, x) for b in batches for t, x in zip(b.column("target").to_pylist(), b.column("x").to_pylist(), strict=True)]
        if rows:
            rows.sort()
            bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES).astype(float) for _, x in rows]
            model = fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([t for t, _ in rows]))
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # the bounded sample meets in one task; the driver gets the fitted numbers only
    parts = sample_of(docs, labels, "quality", bound).mapInArrow(featurise, "x binary, target double")
    found = parts.repartition(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else None


def scores(part: pa.RecordBatch, model: Model | None) -> np.ndarray:
    return model.forward(*passages(*flat(part.column("text"))))[0] if model else np.full(part.num_rows, 0.5)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (the chance of label 1) and predicted of every document.

    Null and empty texts are bags of one empty passage; without a labelled row every
    score is 0.5.  Repeated rows repeat their result.  An id that is labelled several
    times has its largest label, and of its texts one is learnt from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, bound))  # a few thousand numbers

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(scores(part, shared.value))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept.

    Null and empty texts are scored as bags of one empty passage; a repeated row fares as
    its like; without a labelled row every document stays (its score is 0.5).
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, bound))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(scores(part, shared.value) >= threshold))

    return map_whole(docs, apply, docs.columns)
