"""Language ID (9): prediction by partial matching with frozen per-language byte context trees."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grovespark.llm.frames import clean, documents, fold
from grovespark.llm.textops import Slice, blobs, slices, strings, trimmed
from grovespark.runtime import stored, width

ORDER = 3
#: Entries (a byte after a context, for one language) that the tasks hold at once. Trees with more are used in turns, each a part of them.
ENTRIES = 6_000_000
#: Bytes of text worked on at once; numbers of a worker's memo.
PIECE, MEMO = 1 << 20, 8 << 20
FOLDS, HELD = 4, 2
UNKNOWN = "und"
_START = 10  # the byte that stands before a text
_MASKS = [np.uint32((1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1)]


def codes(s: Slice, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """For each byte ``lo..hi``, the three before it in its text and itself, as a 32-bit number."""
    hi = len(s.data) if hi is None else hi
    at = np.arange(lo, hi)
    begin = s.offs[np.searchsorted(s.offs, at, "right") - 1]
    out = s.data[lo:hi].astype(np.uint32)
    for k in range(1, ORDER + 1):
        before = np.where(at - k >= begin, s.data[np.maximum(at - k, 0)], np.uint8(_START))
        out |= before.astype(np.uint32) << np.uint32(8 * k)
    return out


def _pieces(s: Slice) -> Iterator[tuple[int, int]]:
    return ((lo, min(lo + PIECE, len(s.data))) for lo in range(0, len(s.data), PIECE))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    u, back = np.unique(k, return_inverse=True)
    return u, np.bincount(back, c, len(u)).astype(np.int64)


class _Tally:
    """Counts by key for each name, merged as they come."""

    def __init__(self) -> None:
        self.held: dict[tuple[int, int], tuple[list, list]] = {}

    def add(self, name: tuple[int, int], keys: np.ndarray, counts: np.ndarray) -> None:
        ks, cs = self.held.setdefault(name, ([], []))
        ks.append(keys)
        cs.append(counts)
        if len(ks) >= 16:
            k, c = _merge(ks, cs)
            self.held[name] = [k], [c]

    def merged(self) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
        for name in list(self.held):
            yield name, *_merge(*self.held.pop(name))


_TREE = "bucket int, lang int, ord int, keys binary, counts binary"


def context_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """How often each byte follows each context of up to ORDER bytes, by language, over all training texts.

    Rows (bucket, lang, ord, keys, counts): keys are context and byte codes of
    order ``ord``. A bucket holds the codes of some preceding bytes.
    """
    number = {lang: i for i, lang in enumerate(langs)}
    parts = width(docs.sparkSession)

    def rows(lang: int, order: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bucket = (((keys >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts
        order_by = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order_by])) + 1
        ks, cs, bs = np.split(keys[order_by], cut), np.split(counts[order_by], cut), bucket[order_by][np.concatenate([[0], cut])]
        n = len(ks)
        return pa.RecordBatch.from_arrays([pa.array(bs, pa.int32()), pa.array([lang] * n, pa.int32()), pa.array([order] * n, pa.int32()), pa.array([k.astype(np.uint32).tobytes() for k in ks]), pa.array([c.astype(np.int64).tobytes() for c in cs])], ["bucket", "lang", "ord", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for b in batches:
            lang = np.array([number.get(x, -1) for x in b.column(1).to_pylist()])
            for s in slices(strings(b)):
                for lo, hi in _pieces(s):
                    code = codes(s, lo, hi)
                    own = lang[s.lo + np.searchsorted(s.offs, np.arange(lo, hi), "right") - 1]
                    for i in np.unique(own[own >= 0]).tolist():
                        tally.add((i, ORDER), *np.unique(code[own == i], return_counts=True))
        for (i, _), k, c in tally.merged():
            for order in range(ORDER, -1, -1):
                k, c = _merge([k & _MASKS[order]], [c])
                yield rows(i, order, k, c)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for b in batches:
            for lang, order, k, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), blobs(b, "keys", np.uint32), blobs(b, "counts", np.int64)):
                tally.add((lang, order), k, c)
        for (lang, order), k, c in tally.merged():
            yield rows(lang, order, k, c)

    return docs.mapInArrow(trimmed(count), _TREE).repartitionById(parts, F.col("bucket")).mapInArrow(trimmed(total), _TREE)


def turns(trees: DataFrame, langs: int, most: int) -> list[np.ndarray]:
    """Parts of the trees, each flags (language, preceding byte) of at most about ``most`` entries, which together hold every cell once."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, k in zip(b.column(1).to_pylist(), blobs(b, "keys", np.uint32)):
                byte, n = np.unique(k >> np.uint32(8) & np.uint32(255), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.int32()), pa.array(byte.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "byte", "n"])

    cells = trees.where("ord > 0").mapInArrow(sizes, "lang int, byte int, n long").groupBy("lang", "byte").agg(F.sum("n").alias("n")).collect()  # at most 256 a language
    out, room = [np.zeros((langs, 256), bool)], most
    for r in sorted(cells):
        if r.n > room and out[-1].any():
            out.append(np.zeros((langs, 256), bool))
            room = most
        out[-1][r.lang, r.byte] = True
        room -= r.n
    out[-1][~np.any(out, axis=0)] = True  # cells without entries: only order 0
    return out


class Model:
    """Code lengths in nats by the trees of one language: seen bytes and escapes of each context.

    A byte seen after a context costs by its count; one not seen costs the
    escape (as many as there are distinct bytes) and then what the next shorter
    context says of the bytes that the longer one excludes. A context that was
    never met is replaced by the next shorter one at no cost.
    """

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray]]):
        """``trees``: for each order sorted keys and counts; order 0 is whole, the others may be some preceding bytes' part."""
        zero = np.zeros(256)
        zero[trees[0][0]] = trees[0][1]
        kinds = int((zero > 0).sum())
        escape = kinds if kinds < 256 else 0
        with np.errstate(divide="ignore", invalid="ignore"):
            self.zero = np.where(zero > 0, zero / (zero.sum() + escape), 1 / max(1, 256 - kinds) * escape / (zero.sum() + escape)) if kinds else np.full(256, 1 / 256)
        below = np.arange(256, dtype=np.uint32), self.zero
        self.keys, self.costs, self.nodes, self.escapes = [], [], [], []
        for order in range(1, ORDER + 1):
            keys, counts = trees[order]
            nodes, first, many = np.unique(keys >> np.uint32(8), return_index=True, return_counts=True)
            total = np.add.reduceat(counts, first) if len(keys) else counts
            escape = np.where(many < 256, many, 0)
            prob = counts / np.repeat(total + escape, many)
            short = below[1][np.searchsorted(below[0], keys & _MASKS[order - 1])]  # what the shorter context gave the bytes seen here
            rest = 1 - (np.add.reduceat(short, first) if len(keys) else short)
            self.keys.append(keys)
            self.costs.append(-np.log(prob).astype(np.float32))
            self.nodes.append(nodes)
            self.escapes.append(-np.log(np.maximum(escape / (total + escape) / np.maximum(rest, 1e-12), 1e-30)).astype(np.float32))
            below = keys, prob

    def cost(self, code: np.ndarray) -> np.ndarray:
        """Nats of each (context, byte) code of order ORDER."""
        out = np.zeros(len(code), np.float32)
        left = np.arange(len(code))
        for order in range(ORDER, 0, -1):
            keys, nodes = self.keys[order - 1], self.nodes[order - 1]
            if not len(keys):
                continue
            own = code[left] & _MASKS[order]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            seen = keys[at] == own
            out[left[seen]] += self.costs[order - 1][at[seen]]
            left, own = left[~seen], own[~seen] >> np.uint32(8)
            at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
            known = nodes[at] == own
            out[left[known]] += self.escapes[order - 1][at[known]]
        out[left] -= np.log(np.maximum(self.zero[code[left] & np.uint32(255)], 1e-30)).astype(np.float32)
        return out


def models(trees: DataFrame, cells: np.ndarray) -> list[Model]:
    """The models of all languages for the cells of a turn."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for bucket, lang, order, k, c in zip(*(b.column(i).to_pylist() for i in range(3)), blobs(b, "keys", np.uint32), blobs(b, "counts", np.int64)):
                keep = cells[lang][k >> np.uint32(8) & np.uint32(255)] if order else np.ones(len(k), bool)
                rows.append((bucket, lang, order, k[keep].tobytes(), c[keep].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "lang", "ord", "keys", "counts"])

    got: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in trees.mapInArrow(chosen, _TREE).toLocalIterator():
        got.setdefault((r.lang, r.ord), []).append((np.frombuffer(r.keys, np.uint32), np.frombuffer(r.counts, np.int64)))
    none = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
    return [Model([_merge(*zip(*got.get((lang, order), none))) for order in range(ORDER + 1)]) for lang in range(len(cells))]


class _Memo:
    """Costs of the codes met so far, for every language of a turn; starts anew when it holds MEMO numbers."""

    def __init__(self, own: list[Model]):
        self.own, self.codes, self.costs = own, np.zeros(0, np.uint32), np.zeros((0, len(own)), np.float32)

    def rows(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table of costs, and the row of each code in it."""
        u, back = np.unique(code, return_inverse=True)
        new = np.setdiff1d(u, self.codes, assume_unique=True)
        if len(new):
            if (len(self.codes) + len(new)) * len(self.own) > MEMO:
                self.codes, self.costs, new = self.codes[:0], self.costs[:0], u
            codes = np.concatenate([self.codes, new])
            order = np.argsort(codes)
            self.codes = codes[order]
            self.costs = np.concatenate([self.costs, np.stack([m.cost(new) for m in self.own], 1)])[order]
        return self.costs, np.searchsorted(self.codes, u)[back]


_memos: dict[str, _Memo] = {}


def language_id(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """Predict the language of every document: doc_id, held_out, lang_pred, score, code_length.

    Trees are learned from text and lang of all documents outside the held-out
    fold with a lang, and no context is left out. score is the share of the
    prediction's likelihood in that of all languages, code_length its nats. Of
    equal code lengths the first language by code point wins. A null text, one
    without a letter, or a table without any language gives ``und``, score 0 and
    no code length. A null doc_id is predicted and not held out; rows that repeat a
    text agree; an empty table gives an empty result; other columns are ignored;
    a text of any length is worked on PIECE bytes at a time.

    The tasks hold at most about ``entries`` entries of the trees; larger trees
    are used in turns over a table of the texts and their code lengths so far, and
    the sums are the same.
    """
    spark = docs.sparkSession
    own = clean(docs, "doc_id", "text", "lang").withColumn("held_out", fold(FOLDS) == HELD)
    train = own.where("NOT held_out AND lang IS NOT NULL AND text <> ''")
    langs = sorted(r.lang for r in train.select("lang").distinct().collect())
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    rows = own.select("doc_id", "text", "held_out", letter)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, code_length double"
    if not langs:
        return rows.selectExpr("doc_id", "held_out", f"'{UNKNOWN}' AS lang_pred", "double(0) AS score", "double(NULL) AS code_length")
    trees = stored(context_counts(train.select("text", "lang"), langs), "trees")
    parts = turns(trees, len(langs), entries)

    def lengths(batch: pa.RecordBatch, key: str, held: list[Model], cells: np.ndarray) -> np.ndarray:
        """Nats of the texts of a batch in the cells of a turn, by language."""
        if key not in _memos:
            _memos.clear()
            _memos[key] = _Memo(held)
        total = np.zeros((batch.num_rows, len(langs)))
        for s in slices(strings(batch)):
            for lo, hi in _pieces(s):
                code = codes(s, lo, hi)
                table, at = _memos[key].rows(code)
                byte = code >> np.uint32(8) & np.uint32(255)
                cut = np.clip(s.offs, lo, hi) - lo
                some = np.flatnonzero(np.diff(cut))
                for k in range(len(langs)):
                    cost = table[:, k][at]
                    if not cells[k].all():
                        cost = cost * cells[k][byte]
                    total[s.lo + some, k] += np.add.reduceat(cost, cut[:-1][some], dtype=np.float64)
        return total

    def predicted(b: pa.RecordBatch, total: np.ndarray) -> pa.RecordBatch:
        known = b.column(3).to_numpy(zero_copy_only=False)
        best, least = total.argmin(1), total.min(1)
        share = 1 / np.maximum(np.exp(np.clip(least[:, None] - total, -700, 0)).sum(1), 1)
        names = pa.array([langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist())], pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), names, pa.array(np.where(known, share, 0.0)), pa.array(least, mask=~known)], ["doc_id", "held_out", "lang_pred", "score", "code_length"])

    for k, cells in enumerate(parts):
        shared = spark.sparkContext.broadcast((f"{uuid.uuid4().hex}-{k}", models(trees, cells), cells))  # at most about ``entries``, as counted
        first, last = k == 0, k == len(parts) - 1

        def work(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                total = lengths(b, *shared.value)
                if not first:
                    total += np.array(b.column(4).to_pylist()).reshape(total.shape)
                if last:
                    yield predicted(b, total)
                else:
                    yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(total.tolist(), pa.list_(pa.float64()))], ["doc_id", "text", "held_out", "letter", "lengths"])

        rows = rows.mapInArrow(trimmed(work), schema if last else "doc_id long, text string, held_out boolean, letter boolean, lengths array<double>")
        if not last:
            rows = stored(rows, "lengths")
    return rows


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
