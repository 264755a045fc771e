"""Quality classifier (1): random-indexing word vectors, pooled, and a calibrated two-layer network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grovespark.llm.frames import clean, documents, fold, labelled, summed
from grovespark.llm.textops import Slice, Words, slices, strings, table_rows, trimmed

#: Words are hashed to VOCAB rows of DIM numbers; a context is WINDOW words to either side.
#: WIDTH: features of a document.
VOCAB, DIM, WINDOW, ENDING = 1 << 14, 48, 2, 2
WIDTH = 4 * DIM + 2
#: Labelled documents that the network is fitted on at most.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 30, 256, 2e-3, 1e-3
#: Steps of the optimiser at least, so that few labels still train the network.
LEAST_STEPS = 1500
FOLDS, THRESHOLD = 5, 0.3
_U = np.uint64


def rows_of(s: Slice) -> tuple[Words, list[np.ndarray]]:
    """Words of a slice, and the 64-bit keys of the two rows that make a word's vector: the word, and its last ENDING bytes.

    An unseen word still has the row of its ending.
    """
    w = s.words()
    ending = w.range_hashes(np.maximum(w.starts, w.ends - ENDING), w.ends) ^ _U(0xA5A5A5A5A5A5A5A5)
    return w, [w.hashes(), ending]


def contexts(s: Slice, total: np.ndarray) -> None:
    """Add to the rows of each word the sparse ternary index vectors of its neighbours in the same text."""
    w, keys = rows_of(s)
    if len(w.starts) < 2:
        return
    rows = [(k % _U(VOCAB)).astype(np.int64) * DIM for k in keys]
    spots = [((k >> _U(33)) % _U(DIM)).astype(np.int64) for k in keys]
    signs = [1.0 - 2.0 * ((k >> _U(32)) & _U(1)).astype(np.float64) for k in keys]
    text = w.text_of()
    for far in range(1, WINDOW + 1):
        same = np.flatnonzero(text[far:] == text[:-far])
        for a, b in ((same, same + far), (same + far, same)):
            for row in rows:
                for spot, sign in zip(spots, signs):
                    total += np.bincount(row[a] + spot[b], sign[b], VOCAB * DIM).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors from all documents: VOCAB x DIM, zero for a row without context."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCAB * DIM, np.int64)
        for b in batches:
            for s in slices(strings(b)):
                contexts(s, total)
            if np.abs(total).max() > 1 << 30:  # four bytes a number are enough for what a task sends at once
                yield table_rows(total.astype(np.int32), 16)
                total[:] = 0
        yield table_rows(total.astype(np.int32), 16)

    got = summed(clean(docs, "text").mapInArrow(trimmed(count), "block int, part binary"), np.int32, 16)
    v = got.reshape(VOCAB, DIM).astype(np.float64) if len(got) else np.zeros((VOCAB, DIM))
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(s: Slice, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of both vectors of the words of each text, and how like each word's vector is to the next one's; zeros without words."""
    w, keys = rows_of(s)
    out = np.zeros((s.n, WIDTH), np.float32)
    some = np.flatnonzero(w.counts)
    if len(some):
        n = w.counts[some][:, None].astype(np.float32)
        for k, key in enumerate(keys):
            v = vectors[(key % _U(VOCAB)).astype(np.int64)]
            mean = np.add.reduceat(v, w.bounds[some]) / n
            out[some, 2 * k * DIM : (2 * k + 1) * DIM] = mean
            out[some, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, w.bounds[some]) / n - mean * mean, 0))
            like = np.zeros(len(v) + 1)
            np.cumsum(np.einsum("ij,ij->i", v[:-1], v[1:]), out=like[1:-1])
            like[-1] = like[-2]
            out[some, 4 * DIM + k] = (like[w.bounds[some + 1] - 1] - like[w.bounds[some]]) / np.maximum(w.counts[some] - 1, 1)
    return out


@dataclass
class Network:
    """tanh layer, sigmoid output at a temperature that makes held-back probabilities calibrated."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) * self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Adam on the cross-entropy of five sixths of the rows; the epoch and the temperature are chosen on the others.

    Without both labels the network gives the rate of the label it has (1/2 without rows).
    """
    rng = np.random.default_rng(seed)
    shift, scale = (x.mean(0), 1 / (x.std(0) + 1e-3)) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    net = Network(shift, scale, rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    if len(np.unique(y)) < 2 or len(y) < 12:
        net.w2[:] = 0
        rate = (y.sum() + 0.5) / (len(y) + 1)
        net.b2 = float(np.log(rate / (1 - rate)))
        return net
    x = (x - shift) * scale
    order = rng.permutation(len(x))
    back, own = order[: len(x) // 6], order[len(x) // 6 :]
    p = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    sign = np.where(y[back] == 1, 1, -1)
    best, kept = np.inf, [a.copy() for a in p]
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(own)))):
        for lo in range(0, len(own), BATCH):
            k = own[lo : lo + BATCH]
            hid = np.tanh(x[k] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3], -30, 30))) - y[k]) / len(k)
            down = np.outer(err, p[2]) * (1 - hid * hid)
            grads = [x[k].T @ down + DECAY * p[0], down.sum(0), hid.T @ err + DECAY * p[2], np.array([err.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        own = rng.permutation(own)
        z = np.tanh(x[back] @ p[0] + p[1]) @ p[2] + p[3]
        if (loss := np.logaddexp(0, -sign * z).sum()) < best:
            best, kept = loss, [a.copy() for a in p]
    net.w1, net.b1, net.w2, net.b2 = *kept[:3], float(kept[3][0])
    z = np.tanh(x[back] @ net.w1 + net.b1) @ net.w2 + net.b2
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: np.logaddexp(0, -sign * z / t).sum()))
    return net


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Score the quality of every document: doc_id, held_out, score, predicted.

    Word vectors come from the texts of all documents; the network learns from at
    most ``sample`` labelled documents outside the held-out fold. A null or empty
    text has no words and gets the score of zero vectors; a null doc_id is scored
    and not held out; rows that repeat a text have equal scores. An empty table
    gives an empty result; other columns play no part in a score.
    """
    vectors = word_vectors(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vectors)  # VOCAB x DIM floats at any scale

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(strings(b)):
                x = pooled(s, shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.n), b.column(2).slice(s.lo, s.n), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    rows = labelled(docs, labels, "quality", sample, fold(FOLDS) != 0).select("doc_id", "text", "label").mapInArrow(trimmed(features), "doc_id long, label int, x binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64) if rows else np.zeros((0, WIDTH))
    net = fit(x, np.array([r["label"] for r in rows], np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(strings(b)):
                p = net.scores(pooled(s, shared.value))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.n), b.column(2).slice(s.lo, s.n), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = clean(docs, "doc_id", "text").withColumn("held_out", fold(FOLDS) == 0)
    return own.mapInArrow(trimmed(score), "doc_id long, held_out boolean, score double, predicted int")


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
