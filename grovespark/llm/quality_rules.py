"""Quality rules (7): exact counts of each text, and a hashed n-gram log-likelihood ratio with a fixed threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grovespark.llm.frames import carried, clean, documents, summed
from grovespark.llm.textops import Slice, slices, strings, table_rows, trimmed

#: n-grams are runs of NGRAM bytes, hashed to 2**BITS buckets.
NGRAM, BITS = 3, 16
#: A text is kept if its mean log-likelihood ratio per n-gram is at least this.
THRESHOLD = -0.25
SMOOTHING = 0.5
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def grams(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram that lies inside one text, and n-grams by text."""
    d, n = s.data, len(s.data)
    if n < NGRAM:
        return np.zeros(0, np.int64), np.zeros(s.n, np.int64)
    code = np.zeros(n - NGRAM + 1, np.uint32)
    for j in range(NGRAM):
        code = code << np.uint32(8) | d[j : n - NGRAM + 1 + j]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    many = np.maximum(np.diff(s.offs) - (NGRAM - 1), 0)
    inside = np.ones(n - NGRAM + 1, bool)
    for j in range(1, NGRAM):
        over = s.offs[1:-1] - j
        inside[over[(over >= 0) & (over < len(inside))]] = False
    return bucket[inside].astype(np.int64), many


def counts(s: Slice) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = s.words()
    h, at, many = w.runs(w.hashes(), 3)
    covered = np.zeros(len(w.starts), bool)
    if len(h):
        key = h ^ (np.repeat(np.arange(s.n), many).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(3):
            covered[at[twice] + j] = True
    total = np.concatenate([[0], np.cumsum(covered)])
    lines = np.zeros(s.n, np.int64)
    for i in np.flatnonzero(s.per_text(s.data == 10)):
        own = [x for x in s.text(i).split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[i] = len(own) - len(set(own))
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": s.per_text(w.solid & ((s.data & 0xC0) != 0x80)),
        "n_symbols": s.per_text(_SYMBOL[s.data]),
        "n_dup_lines": lines,
        "n_repeat_words": total[w.bounds[1:]] - total[w.bounds[:-1]],
    }


def log_ratio(docs: DataFrame, trusted_ids: DataFrame) -> np.ndarray:
    """log of the trusted target's over the raw corpus's multinomial for each bucket.

    Raw counts cover every document, the target's every document whose
    ``doc_id`` is in ``trusted_ids``. Ids and documents are sorted by id at
    every size, for the ids grow with the labels; null ids, which match nothing,
    are spread by their text. Without a trusted document the ratio is 0 everywhere.
    """
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for b in batches:
            trusted = b.column(1).to_numpy(zero_copy_only=False)
            for s in slices(strings(b)):
                g, many = grams(s)
                total[0] += np.bincount(g, minlength=size)
                total[1] += np.bincount(g[np.repeat(trusted[s.lo : s.hi] == 1, many)], minlength=size)
        yield table_rows(total, 16)

    ids = trusted_ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), F.lit(0).cast("long").alias("_salt"), F.lit(1).alias("trusted")).distinct().hint("merge")
    salted = clean(docs, "doc_id", "text").withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))
    flagged = salted.join(ids, (F.col("doc_id") == F.col("_id")) & (F.col("salt") == F.col("_salt")), "left").select("text", F.coalesce("trusted", F.lit(0)).alias("trusted"))
    got = summed(flagged.mapInArrow(trimmed(count), "block int, part binary"), np.int64, 16)
    if not len(got):
        return np.zeros(size)
    raw, target = got.reshape(2, size)
    if not target.sum():
        return np.zeros(size)
    return np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * size)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * size))


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """Judge every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, llr (mean log-likelihood ratio per n-gram) and kept. A null or
    empty text has no words and fails; a text shorter than an n-gram has llr 0.
    Each row is judged by itself, so repeated rows and ties agree; an empty
    table gives an empty result; other columns are ignored. Trigram repeats are
    found by 64-bit hashes.
    """
    ratio = log_ratio(docs, trusted_ids)
    place = docs.columns.index("text") if carry else 0

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # The text travels once: by itself, or in the row that is passed on.
            texts = b.column(1).field(place) if carry else b.column(1)
            for s in slices(texts):
                c = counts(s)
                g, many = grams(s)
                score = np.bincount(np.repeat(np.arange(s.n), many), ratio[g], s.n) / np.maximum(many, 1)
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                out = [b.column(0).slice(s.lo, s.n), *c.values(), failed, score, ~failed & (score >= threshold), *([b.column(1).slice(s.lo, s.n)] if carry else [])]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], ["doc_id", *c, "base_failed", "llr", "kept", *(["document"] if carry else [])])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    if not carry:
        return clean(docs, "doc_id", "text").mapInArrow(trimmed(judge), schema)
    own = carried(docs, "doc_id")
    return own.mapInArrow(trimmed(judge), f"{schema}, document {own.schema['document'].dataType.simpleString()}")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality_rules(documents(spark, sf_dir), trusted)
