"""Toxicity (5): multiple-instance learning of sentence scores under a noisy-or, from document labels alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grovespark.llm.frames import clean, documents, fold, labelled, summed
from grovespark.llm.textops import Slice, slices, strings, table_rows, trimmed

#: Words and their first bytes are hashed to 2**BITS features.
BITS, PREFIXES = 18, (4, 5, 6)
#: Labelled documents learned from at most.
SAMPLE = 20_000
#: A feature can tell if it is in this many toxic documents and this many times likelier in them.
LEAST, RATIO = 3, 4.0
STEPS, RATE, DECAY = 300, 0.1, 1e-5
FOLDS, THRESHOLD = 5, 0.5
_U = np.uint64
_CLOSER = np.zeros(256, bool)
_CLOSER[list(b".!?")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?\"')(")] = True


class Sentences:
    """Sentences of a slice: runs of words up to a closing mark or a line's end; features of their words."""

    def __init__(self, s: Slice):
        self.w = w = s.words(lower=True)
        n = len(w.starts)
        opens = np.zeros(n, bool)
        opens[w.bounds[:-1][w.counts > 0]] = True
        if n:
            opens[1:] |= _CLOSER[s.data[w.ends[:-1] - 1]]
            opens |= (w.starts > 0) & (s.data[np.maximum(w.starts - 1, 0)] == 10)
        self.first = np.flatnonzero(opens)  # word that begins each sentence
        self.of_word = np.cumsum(opens) - 1
        self.text = w.text_of()[self.first]
        last = np.append(self.first[1:], n)[: len(self.first)] - 1
        self.start, self.end = w.starts[self.first], w.ends[last] if n else w.ends

    def features(self) -> list[np.ndarray]:
        """Buckets of each word: the word without punctuation at its ends, and its first 4, 5 and 6 bytes."""
        w = self.w
        a, b = w.starts.copy(), w.ends.copy()
        for _ in range(3):
            a += _PUNCT[w.data[np.minimum(a, b - 1)]] & (b - a > 1)
            b -= _PUNCT[w.data[np.maximum(b - 1, a)]] & (b - a > 1)
        out = [w.range_hashes(a, b)]
        out += [w.range_hashes(a, np.minimum(b, a + k)) + _U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in PREFIXES]
        return [(h >> _U(64 - BITS)).astype(np.int64) for h in out]


def noisy_or(logits: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sentence probabilities, and log of the chance that no sentence of a text is toxic."""
    z = np.clip(logits, -40, 40)
    return 1 / (1 + np.exp(-z)), np.bincount(text, -np.logaddexp(0, z), n)


def fit(docs: int, y: np.ndarray, sentence_doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the likelihood of the document labels under the noisy-or."""
    w, bias = np.zeros(size), -6.0
    m, v, step = np.zeros(size + 1), np.zeros(size + 1), 0
    for _ in range(STEPS):
        p, none = noisy_or(bias + np.bincount(sentence, w[feature], len(sentence_doc)), sentence_doc, docs)
        some = -np.expm1(np.minimum(none, -1e-12))
        # d log-likelihood / d logit of a sentence: p (1 - P) / P if the document is toxic, -p if not.
        by_doc = np.where(y == 1, np.exp(none) / np.maximum(some, 1e-9), -1.0)
        by_sentence = p * by_doc[sentence_doc]
        grad = -np.append(np.bincount(feature, by_sentence[sentence], size), by_sentence.sum()) / docs
        grad[:size] += DECAY * w
        step += 1
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:size]
        bias = min(-2.0, bias - move[size])
    return w, bias


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Feature weights (0 for those that can't tell) and bias, from at most ``sample`` labelled training documents.

    First the document frequencies of all features, by label, then only the
    telling ones of each sentence go to the driver.
    """
    few = labelled(docs, labels, "toxic", sample, fold(FOLDS) != 0).select("doc_id", "text", "label")
    size = 1 << BITS

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size + 1), np.int64)
        for b in batches:
            label = b.column(2).to_numpy(zero_copy_only=False)
            for s in slices(strings(b)):
                own = Sentences(s)
                text = own.w.text_of()
                key = np.unique(np.concatenate([text * size + f for f in own.features()]))
                for y in (0, 1):
                    total[y, :size] += np.bincount(key[label[s.lo + key // size] == y] % size, minlength=size)
                    total[y, size] += int((label[s.lo : s.hi] == y).sum())
        yield table_rows(total, 16)

    got = summed(few.mapInArrow(trimmed(frequencies), "block int, part binary"), np.int64, 16)
    if not len(got):
        return np.zeros(size), -6.0
    clean_, toxic = got.reshape(2, size + 1)
    rate = lambda c: (c[:size] + 0.5) / (c[size] + 1)
    telling = (toxic[:size] >= LEAST) & (rate(toxic) >= RATIO * rate(clean_))
    number = np.where(telling, np.cumsum(telling) - 1, -1)

    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(strings(b)):
                own = Sentences(s)
                feats = number[np.stack(own.features())]
                word = np.broadcast_to(np.arange(feats.shape[1]), feats.shape)[feats >= 0]
                key = np.unique(own.of_word[word] * size + feats[feats >= 0])
                sent, feat = key // size, key % size
                doc = own.text[sent]
                base = np.searchsorted(own.text, np.arange(s.n))
                many = np.bincount(own.text, minlength=s.n)
                ends = np.searchsorted(doc, np.arange(s.n), "right")
                starts = np.searchsorted(doc, np.arange(s.n))
                cells = [np.stack([sent[lo:hi] - base[i], feat[lo:hi]]).astype(np.int32).tobytes() for i, (lo, hi) in enumerate(zip(starts, ends))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.n), b.column(2).slice(s.lo, s.n), pa.array(many.astype(np.int32)), pa.array(cells, pa.binary())], ["doc_id", "label", "many", "cells"])

    rows = few.mapInArrow(trimmed(instances), "doc_id long, label int, many int, cells binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["cells"]))
    cells = [np.frombuffer(r["cells"], np.int32).reshape(2, -1) for r in rows]
    many = np.array([r["many"] for r in rows], np.int64)
    first = np.cumsum(many) - many
    sentence = np.concatenate([c[0] + f for c, f in zip(cells, first)] or [np.zeros(0, np.int64)])
    feature = np.concatenate([c[1] for c in cells] or [np.zeros(0, np.int64)]).astype(np.int64)
    y = np.array([r["label"] for r in rows])
    weights, bias = fit(len(rows), y, np.repeat(np.arange(len(rows)), many), sentence, feature, max(1, int(telling.sum()))) if y.any() else (np.zeros(1), -6.0)
    out = np.zeros(size)
    out[telling] = weights[: int(telling.sum())]
    return out, bias


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Score every document and locate its offending sentences.

    Returns doc_id, held_out, score, predicted, and offending: byte ranges
    (start, end) and scores of the sentences at ``threshold`` or above. Labels
    are learned from at most ``sample`` documents outside the held-out fold. A
    null or empty text has no sentence and the score 0; a null doc_id is scored
    and not held out; rows that repeat a text have equal results. An empty table
    gives an empty result; other columns play no part in a score.
    """
    weights, bias = learn(docs, labels, sample)
    weights = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS floats at any scale

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(strings(b)):
                own = Sentences(s)
                word = sum(weights.value[f] for f in own.features())
                p, none = noisy_or(bias + np.bincount(own.of_word, word, len(own.first)), own.text, s.n)
                total = -np.expm1(none)
                hot = np.flatnonzero(p >= threshold)
                many = np.bincount(own.text[hot], minlength=s.n)
                at = own.start[hot] - s.offs[own.text[hot]], own.end[hot] - s.offs[own.text[hot]]
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.StructArray.from_arrays([pa.array(at[0], pa.int64()), pa.array(at[1], pa.int64()), pa.array(p[hot])], ["start", "end", "score"]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.n), b.column(2).slice(s.lo, s.n), pa.array(total), pa.array((total >= threshold).astype(np.int32)), spans], ["doc_id", "held_out", "score", "predicted", "offending"])

    own = clean(docs, "doc_id", "text").withColumn("held_out", fold(FOLDS) == 0)
    return own.mapInArrow(trimmed(score), "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:long,end:long,score:double>>")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
