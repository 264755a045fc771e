"""Mixing sources to target weights (8): fixed-length blocks drawn by per-source permutations.

Slots of the mix are independent draws of a source by weight, given that each
source fills its target to the word. So the counts of a shard are multinomial
draws conditioned on the totals, and those of a range of shards are drawn by
halving: a task walks from all shards to its own, and has their counts and the
counts before them without the draws of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from grovespark.llm.frames import clean, documents, placed
from grovespark.llm.textops import mix as scramble
from grovespark.llm.textops import slices, strings, trimmed
from grovespark.runtime import stored, width

#: Words of a block, blocks of an output shard, weights by source in turn.
BLOCK, SHARD, WEIGHTS = 64, 4096, (3.0, 1.0, 2.0)
#: Shards drawn by one task at least, where there are more than the session's partitions.
TASK_SHARDS = 256
#: Slots above which a range is halved by shares; exact draws take over below.
EXACT = 500_000_000
SHARE, REPEATS, SEED = 1.5, 2, 20
_U = np.uint64


def targets(sizes: list[int], weights: list[float], share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Split ``share`` of all sizes by weight; no source gets over ``repeats`` times its size, the excess goes to the others by weight."""
    total, caps = share * sum(sizes), [repeats * s for s in sizes]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        by = sum(weights[i] for i in sorted(free))
        for i in free:
            out[i] = left * weights[i] / by
        over = {i for i in free if out[i] > caps[i]}
        if not over:
            break
        for i in over:
            out[i] = float(caps[i])
        free -= over
    return out


def _halves(n: int) -> tuple[int, np.uint64]:
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    return half, _U((1 << half) - 1)


def _salt(key: int, r: int) -> np.uint64:
    return _U((key * 4 + r) * 0x9E3779B97F4A7C15 % (1 << 64))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Image of each index below ``n`` under the pseudorandom permutation ``key``: a Feistel network, walked until below n."""
    half, mask = _halves(n)
    out = np.asarray(index).astype(_U)
    left = np.arange(len(out))
    while len(left):
        hi, lo = out[left] >> _U(half), out[left] & mask
        for r in range(4):
            hi, lo = lo, hi ^ (scramble(lo + _salt(key, r)) & mask)
        out[left] = hi << _U(half) | lo
        left = left[out[left] >= _U(n)]
    return out.astype(np.int64)


def place_of(image: int, n: int, key: int) -> int:
    """The index whose image under :func:`permuted` is ``image``."""
    half, mask = _halves(n)
    x = np.array([image], _U)
    while True:
        hi, lo = x >> _U(half), x & mask
        for r in range(3, -1, -1):
            hi, lo = lo ^ (scramble(hi + _salt(key, r)) & mask), hi
        x = hi << _U(half) | lo
        if x[0] < n:
            return int(x[0])


def _key(seed: int, source: int, epoch: int) -> int:
    return (seed * 1000 + epoch) * 65537 + source


def slots_of(size: int, target: float, source: int, block: int = BLOCK, seed: int = SEED) -> tuple[int, int]:
    """How many slots fill a source's target, and the words of its last slot, which is cut to meet the target to the word."""
    goal = int(target + 0.5)
    if not goal:
        return 0, 0
    have = -(-size // block)
    epoch, rest = divmod(goal, size)
    if not rest:
        epoch, rest = epoch - 1, size
    many, short = -(-rest // block), have * block - size
    if short and place_of(have - 1, have, _key(seed, source, epoch)) < many:  # the short last block is among them
        many = -(-(rest + short) // block)
        if place_of(have - 1, have, _key(seed, source, epoch)) == many - 1:
            return epoch * have + many, rest - (many - 1) * block
        return epoch * have + many, rest + short - (many - 1) * block
    return epoch * have + many, rest - (many - 1) * block


def _half(totals: np.ndarray, take: int, key: list[int]) -> np.ndarray:
    """How many of ``take`` slots drawn without return from ``totals`` fall to each source."""
    rng = np.random.default_rng(key)
    if totals.sum() <= EXACT:
        return rng.multivariate_hypergeometric(totals, take, method="marginals")
    share = totals * (take / totals.sum())
    out = np.minimum(np.floor(share).astype(np.int64), totals)
    while (rest := take - int(out.sum())) > 0:
        room = np.where(totals > out, share - np.floor(share) + 1e-9, 0)
        out = np.minimum(out + rng.multinomial(rest, room / room.sum()), totals)
    return out


def draw(totals: np.ndarray, per_shard: int, lo: int, hi: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source, slots of each source in earlier shards) of the shards ``lo..hi``.

    ``totals``: slots of each source in the whole mix. Only the last shard may
    be shorter than ``per_shard``. A shard's counts don't depend on the range asked for.
    """
    slots = int(totals.sum())
    open_ranges = [(0, -(-slots // per_shard), totals.astype(np.int64), np.zeros(len(totals), np.int64))]
    while open_ranges:
        a, b, own, before = open_ranges.pop()
        if b <= lo or a >= hi:
            continue
        if b - a == 1:
            yield a, own, before
            continue
        mid = (a + b) // 2
        left = _half(own, (mid - a) * per_shard, [seed, a, b])
        open_ranges += [(mid, b, own - left, before + left), (a, mid, left, before)]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0) and _row (null if there is none) of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [s.words().counts for s in slices(strings(b))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(sizes or [np.zeros(0)]).astype(np.int64)), b.column(3)], ["doc_id", "source", "size", "_row"])

    return clean(docs, "doc_id", "source", "text", "_row").mapInArrow(trimmed(count), "doc_id long, source string, size long, _row long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Mix all documents; returns (documents, slots).

    documents: doc_id, source, size, source_size, target, taken (words that the
    mix takes, repeats counted), source_no and first (the words before it in its
    source, documents in order of their hash). slots: out_shard, slot, source_no,
    epoch, block, words and held (the block's words) of each slot of the mix;
    block b of a source holds its words ``b * block`` and on. A source's last slot
    takes the first words of its block, so that the target is met to the word.

    Sources come by code point, null last, and take the weights in turn. A null
    or empty text has size 0 and is never taken; a null doc_id is a document
    like others; rows that repeat an id are documents of their own. Documents
    with equal hash order are ordered by id and size. An empty table gives empty
    results; other columns are ignored. Reruns agree: every draw follows from
    ``seed`` and indexes. One row per source, never per document, comes to the
    driver.
    """
    spark = docs.sparkSession
    rows = stored(sized(docs), "sizes")
    sources = sorted(((r.source, r.size) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [s for _, s in sources]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, repeats)
    known = spark.createDataFrame([(i, n, s, t) for i, ((n, s), t) in enumerate(zip(sources, goal))], "source_no int, source string, source_size long, target double")
    rows = rows.join(known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # Blocks of each document: its words are a run of its source's stream.
    put = stored(placed(rows, ["source_no"], ["doc_id", "size"], F.col("size"), "first"), "streams")
    first, last = (F.col("first") / block).cast("long"), ((F.col("first") + F.col("size") - 1) / block).cast("long")
    parts = put.where("size > 0").select("source_no", "doc_id", "first", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin, end = F.greatest(F.col("first") - F.col("block") * block, F.lit(0)), F.least(F.col("first") + F.col("size") - F.col("block") * block, F.lit(block))
    parts = parts.select("source_no", "doc_id", "first", "block", begin.alias("begin"), end.alias("end"))

    # Slots: a shard's slots of a source continue where the shard before left off.
    have = np.array([-(-s // block) for s in sizes], np.int64)
    ends = [slots_of(s, t, i, block, seed) for i, (s, t) in enumerate(zip(sizes, goal))]
    want, cut = np.array([n for n, _ in ends], np.int64), [w for _, w in ends]
    shards = -(-int(want.sum()) // SHARD)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["out_shard", "slot", "source_no", "epoch", "block", "words", "held"]
        for b in batches:
            own = b.column(0).to_pylist()
            if not own:
                continue
            for shard, many, start in draw(want, SHARD, own[0], own[-1] + 1, seed):
                cols: list[list[np.ndarray]] = [[] for _ in names]
                for no in np.flatnonzero(many).tolist():
                    at = start[no] + np.arange(many[no])
                    epoch, inside = at // have[no], at % have[no]
                    image = np.zeros(len(at), np.int64)
                    for e in np.unique(epoch).tolist():
                        image[epoch == e] = permuted(inside[epoch == e], int(have[no]), _key(seed, no, e))
                    held = np.minimum(block, sizes[no] - image * block).astype(np.int32)
                    words = np.where(at == want[no] - 1, np.int32(cut[no]), held)
                    for col, v in zip(cols, (np.full(len(at), shard, np.int32), at, np.full(len(at), no, np.int32), epoch.astype(np.int32), image, words, held)):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)

    tasks = max(1, min(shards, max(width(spark), -(-shards // TASK_SHARDS))))
    slots = spark.range(0, shards, 1, tasks).mapInArrow(trimmed(spread), "out_shard int, slot long, source_no int, epoch int, block long, words int, held int")

    # Join blocks by index: a block's full slots, and the slot that the target cuts short.
    # Both sides grow with the data; slots come from a short range, whose size would mislead the planner into a broadcast.
    times = slots.groupBy("source_no", "block").agg(F.count_if(F.col("words") == F.col("held")).alias("times"), F.sum(F.when(F.col("words") < F.col("held"), F.col("words")).otherwise(0)).alias("cut")).hint("merge")
    words = F.col("times") * (F.col("end") - F.col("begin")) + F.greatest(F.least("end", "cut") - F.col("begin"), F.lit(0))
    taken = parts.join(times, ["source_no", "block"]).groupBy("source_no", "doc_id", "first").agg(F.sum(words).alias("taken"))
    taken = taken.select(F.col("source_no").alias("_s"), F.col("first").alias("_f"), "taken").hint("merge")
    out = put.join(taken, (F.col("source_no") == F.col("_s")) & (F.col("first") == F.col("_f")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source_no", "first", "_row"), slots


def copies(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, _row (as ``docs`` has it) and times of every document that the mix keeps, for mixes of whole documents.

    A document comes out the whole part of taken / size times. The fractions of
    a source are summed along its documents in order of size, from a seeded
    start, and a document comes out once more where the sum passes a whole
    number. So no length is favoured, and what a source gives differs from what
    the mix takes by about a document, not by a share. Bands of sizes (a
    twelfth wide) stand for the full order. Rows that repeat id and source are
    documents of their own; documents equal in all that orders them are
    interchangeable.
    """
    one = F.lit(1 << 32)
    part = F.expr("shiftleft(taken % size, 32) div size")
    rates = mix(docs, seed=seed)[0].where("size > 0").select("doc_id", "source", "_row", "size", F.expr("taken div size").alias("whole"), part.alias("part"), F.floor(F.log2("size") * 8).cast("int").alias("band"))
    rates = stored(rates, "rates")
    before = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = rates.groupBy("source", "band").agg(F.sum("part").alias("part")).select(F.col("source").alias("_source"), F.col("band").alias("_band"), F.coalesce(F.sum("part").over(before), F.lit(0)).alias("_before"))
    put = placed(rates, ["source", "band"], ["size", "doc_id", "part"], F.col("part"), "inside")
    put = put.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("band") == F.col("_band")))
    at = F.col("_before") + F.col("inside") + F.pmod(F.xxhash64("source", F.lit(seed)), one)
    more = F.shiftright(at + F.col("part"), 32) - F.shiftright(at, 32)
    return put.select("doc_id", "source", "_row", (F.col("whole") + more).cast("int").alias("times")).where("times > 0")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))[0].select("doc_id", "size", "source_size", "target", "taken")
