"""Best-fit packing (10): exact-complement hashing over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grovespark.llm.frames import clean, documents, placed
from grovespark.llm.textops import longs, slices, strings, trimmed
from grovespark.llm.tokens import coder, default_path
from grovespark.runtime import stored

LIMIT, END = 1024, 2


class SumIndex:
    """Sums of one, two and three available lengths, hashed by their value.

    ``pairs[s]`` lists the greater members of the pairs of sum s; a pair leaves
    its list once a member is used up. ``live[s]`` counts the pairs left, so that
    the triples of a sum are the lengths whose rest still has a pair.
    """

    def __init__(self, counts: np.ndarray):
        self.h = np.array(counts, np.int64)
        lengths = np.flatnonzero(self.h[1:]) + 1
        self.live = np.zeros(len(self.h), np.int64)
        self.pairs: dict[int, list[int]] = {}
        for a in lengths.tolist():  # ascending, so that a list ends with its longest
            for s in (a + lengths[(lengths <= a) & (lengths < len(self.h) - a)]).tolist():
                self.pairs.setdefault(s, []).append(a)
                self.live[s] += 1

    def has(self, items: list[int]) -> bool:
        return all(self.h[x] >= items.count(x) for x in set(items))

    def take(self, items: list[int]) -> int:
        """Consume the combination as often as its counts allow."""
        n = min(int(self.h[x]) // items.count(x) for x in set(items))
        for x in set(items):
            self.h[x] -= n * items.count(x)
        for x in {x for x in items if not self.h[x]}:
            rest = np.flatnonzero(self.h[1 : len(self.h) - x]) + 1
            self.live[x + rest] -= 1
            if 2 * x < len(self.h):
                self.live[2 * x] -= 1
            for y in {y for y in items if y != x and not self.h[y] and y < x and x + y < len(self.h)}:
                self.live[x + y] -= 1  # both went at once
        return n

    def single(self, gap: int, rest: list[int]) -> list[int] | None:
        return [gap] if self.has([*rest, gap]) else None

    def pair(self, gap: int, rest: list[int]) -> list[int] | None:
        """The pair of sum ``gap`` with the longest first member that is available beside ``rest``."""
        own = self.pairs.get(gap, [])
        own[:] = [a for a in own if self.h[a] and self.h[gap - a]]
        return next(([a, gap - a] for a in reversed(own) if self.has([*rest, a, gap - a])), None)

    def triple(self, gap: int, rest: list[int]) -> list[int] | None:
        x = np.arange(gap - 2, 0, -1)
        for first in x[(self.h[x] > 0) & (self.live[gap - x] > 0)].tolist():
            if found := self.pair(gap - first, [*rest, first]):
                return [first, *found]
        return None

    def fitting(self, gap: int, rest: list[int]) -> int:
        """The longest available length of at most ``gap``, 0 if there is none."""
        return next((int(x) for x in np.flatnonzero(self.h[1 : gap + 1])[::-1] + 1 if self.has([*rest, int(x)])), 0)


def plan(counts: np.ndarray, triples: bool = True) -> list[tuple[tuple[int, ...], int]]:
    """Fill sequences of ``len(counts) - 1`` tokens: (lengths in a sequence, sequences filled so).

    ``counts[n]`` pieces have length n. From the longest piece down, the gap it
    leaves is looked up in the index of the sums of one, two and three lengths,
    and a combination that fills it exactly is consumed as often as its counts
    allow. A piece without an exact complement takes the longest pieces that fit
    (best fit) until nothing fits.
    """
    index = SumIndex(counts)
    limit = len(index.h) - 1
    out: list[tuple[tuple[int, ...], int]] = []
    for top in range(limit, 0, -1):
        while index.h[top]:
            gap, items = limit - top, [top]
            if gap:
                found = index.single(gap, items) or index.pair(gap, items) or (index.triple(gap, items) if triples else None)
                if found:
                    items += found
                else:
                    while gap and (x := index.fitting(gap, items)):
                        items.append(x)
                        gap -= x
            out.append((tuple(sorted(items, reverse=True)), index.take(items)))
    return out


def best_plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """The plan with the fewest sequences of those with and without triples."""
    return min((plan(counts, t) for t in (True, False)), key=lambda p: sum(n for _, n in p))


def ranges(patterns: list[tuple[tuple[int, ...], int]], limit: int) -> list[np.ndarray]:
    """Where the r-th piece of a length goes: sorted keys ``length << 44 | first r``, first sequence, offset."""
    rank = np.zeros(limit + 1, np.int64)
    rows, base = [], 0
    for items, n in patterns:
        at = 0
        for x in items:
            rows.append((x << 44 | int(rank[x]), base, at))
            rank[x] += n
            at += x
        base += n
    return [np.array(c, np.int64) for c in zip(*sorted(rows))] if rows else [np.zeros(0, np.int64)] * 3


def pieces(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and text_crc32 for an order among equal ids."""
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            ids_of, none = longs(b, "doc_id")
            for s in slices(strings(b)):
                ids, many = code.encode(s)
                raw, at = ids.astype("<u4").tobytes(), 0
                rows: list[tuple[int, int, int, int, int]] = []
                for i, n in enumerate(many.tolist()):
                    own = raw[4 * at : 4 * (at + n)] + end
                    at += n
                    n += 1
                    start, size, k = 0, (n - 1) % limit + 1, 0
                    while start < n:
                        rows.append((i, k, start, size, zlib.crc32(own[4 * start : 4 * (start + size)])))
                        start, size, k = start + size, limit, k + 1
                c = np.array(rows, np.int64).T
                doc = pa.array(ids_of[s.lo + c[0]], pa.int64(), mask=none[s.lo + c[0]])
                yield pa.RecordBatch.from_arrays([doc, pa.array(c[1].astype(np.int32)), *[pa.array(x) for x in c[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return clean(docs, "doc_id", "text").mapInArrow(trimmed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``limit`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id and offset. A null or empty text is one token, the end. Only a
    document longer than ``limit`` is cut, and only its first piece may be
    shorter than that. Rows that repeat a doc_id are packed each by itself; a
    null doc_id stays null. An empty table gives an empty result; other columns
    are ignored.

    Plans hold lengths and counts alone, so the driver works on ``limit``
    numbers at any scale; a piece finds its place from its rank among the pieces
    of its length.
    """
    cut = stored(pieces(docs, limit, path), "pieces")
    counts = np.zeros(limit + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``limit`` rows
        counts[r["length"]] = r["count"]
    keys, sequence, offset = ranges(best_plan(counts), limit)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = longs(b, "length")[0] << 44 | longs(b, "rank")[0]
            k = np.searchsorted(keys, at, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence[k] + at - keys[k]), pa.array(offset[k])], [*b.schema.names[:-1], "sequence_id", "offset"])

    ranked = placed(cut, ["length"], ["doc_id", "piece", "ids_crc32", "start"], name="rank")
    return ranked.mapInArrow(trimmed(put), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
