"""N-gram Jaccard join (4): prefixes of rare shingles, combinations of frequent ones, then verification.

Sets are compared as 48-bit shingle hashes. The order of shingles is by document
frequency, then by hash; two similar sets have one shingle in common among the
first ``n - ceil(t n) + 1`` of each (the prefix), and 1 + k if the prefix is k
longer. If the first one that they share is rare, they meet under it. Else all
that they share are frequent; dealt to k groups, two of 1 + k are in one group,
so they meet under a pair of frequent shingles of a group. With k near the length
of the prefix a set has about two such pairs for each shingle of its prefix.

Frequencies are exact and come from one exchange of the shingles; shingles of one
document alone never leave their bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from grovespark.llm.frames import clean, documents
from grovespark.llm.textops import Slice, blobs, longs, mix, slices, strings, trimmed
from grovespark.operators.components import connected_components
from grovespark.runtime import stored, width

SHINGLE, PERCENT = 5, 75
#: Bytes of text and documents that a map task exchanges at once.
CHUNK, CHUNK_DOCS = 6 << 20, 50_000
#: A shingle of more documents than this is of the frequent class.
FREQUENT = 32
#: Rounds in which the sets of a key meet one set of them, before all pairs across components that are left.
STARS = 2
#: Sets of a key that one task pairs at once in the last step; keys with more are cut into blocks.
BLOCK = 256
#: Sets of equal shingles with more than this share of all documents are joined by a broadcast, of 1 / HOT rows at most.
HOT = 1e-3
_U = np.uint64
_BITS = _U(48)
_MASK = _U((1 << 48) - 1)


def shingle_sets(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: sorted ``text << 48 | hash``, and set sizes."""
    w = s.words(lower=True)
    h = w.hashes()
    runs, _, many = w.runs(h, SHINGLE)
    keys = [(np.repeat(np.arange(s.n), many).astype(_U) << _BITS) | (runs & _MASK)]
    for k in range(1, SHINGLE):  # shorter texts: all their words as one
        own = np.flatnonzero(w.counts == k)
        if len(own):
            one = np.zeros(len(own), _U)
            for j in range(k):
                one = one * _U(0xD6E8FEB86659FD93) + h[w.bounds[own] + j]
            keys.append((own.astype(_U) << _BITS) | (mix(one + _U(k)) & _MASK))
    sets = np.sort(np.concatenate(keys))
    if len(sets):
        sets = sets[np.concatenate([[True], sets[1:] != sets[:-1]])]
    return sets, np.bincount((sets >> _BITS).astype(np.int64), minlength=s.n).astype(np.int64)


def signatures(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share, from sums over their scrambled shingles."""
    out = []
    for salt in (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344)):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(tokens ^ salt), dtype=_U)])
        ends = np.cumsum(sizes)
        out.append((total[ends] - total[ends - sizes] + sizes.astype(_U)).view(np.int64))
    return out[0], out[1]


def least_overlap(n):
    """The least intersection with any set that is similar to one of size n."""
    return (PERCENT * n + 99) // 100


_SENT = "target int, chunk long, kind int, a binary, b binary, c binary"
_NAMES = ["target", "chunk", "kind", "a", "b", "c"]


def _row(target: int, chunk: int, kind: int, a, b, c) -> tuple:
    return target, chunk, kind, a.tobytes(), b.tobytes(), c.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def _sender(parts: int):
    """Map side: the shingles of each chunk of documents by bucket, and one row with the chunk's documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = many = 0

        def flush() -> pa.RecordBatch:
            ids, none, sizes, tokens = (np.concatenate([h[k] for h in held]) for k in range(4))
            s1, s2 = signatures(tokens, sizes)
            # Equal sets of a chunk are sent once.
            _, first = np.unique(np.stack([s1, s2], 1), axis=0, return_index=True)
            sent = np.zeros(len(ids), bool)
            sent[first] = True
            sent &= sizes > 0
            doc = np.repeat(np.arange(len(ids)), sizes)
            keep = sent[doc]
            doc, tok = doc[keep], tokens[keep]
            bucket = (tok % _U(parts)).astype(np.uint16 if parts < 65536 else np.int64)
            order = np.argsort(bucket, kind="stable")
            doc, tok = doc[order], tok[order]
            ends = np.cumsum(np.bincount(bucket, minlength=parts))
            rows = []
            for k, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                if lo < hi:
                    d = np.diff(doc[lo:hi], prepend=0).astype(np.uint16)
                    rows.append(_row(k, chunk, 0, d, (tok[lo:hi] >> _U(32)).astype(np.uint16), tok[lo:hi].astype(np.uint32)))
            rows.append(_row(chunk_target(chunk, parts), chunk, 1, np.concatenate([ids, none.astype(np.int64)]), np.concatenate([sizes, sent.astype(np.int64)]), np.concatenate([s1, s2])))
            return _batch(rows)

        for b in batches:
            ids, none = longs(b, "doc_id")
            for s in slices(strings(b)):
                for part in _fewer(s):
                    sets, sizes = shingle_sets(part)
                    held.append((ids[part.lo : part.hi], none[part.lo : part.hi], sizes, sets & _MASK))
                    size += len(part.data)
                    many += part.n
                    if size >= CHUNK or many >= CHUNK_DOCS:
                        yield flush()
                        held, size, many, chunk = [], 0, 0, chunk + 1
        if held:
            yield flush()

    return send


def _fewer(s: Slice, most: int = 10_000) -> Iterator[Slice]:
    """Parts of a slice with at most that many texts, so that a text's number fits beside a hash."""
    for lo in range(0, s.n, most):
        hi = min(s.n, lo + most)
        a, b = s.offs[lo], s.offs[hi]
        yield Slice(s.lo + lo, s.lo + hi, s.data[a:b], s.offs[lo : hi + 1] - a)


def chunk_target(chunk: int, parts: int) -> int:
    return ((chunk >> 24) * 31 + (chunk & 0xFFFFFF)) % parts


def _counter(parts: int):
    """Bucket side: frequency of each shingle; those of two documents or more go back to their chunks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, docs, toks, owner = [], [], [], []
        for b in batches:
            kind = b.column(2).to_pylist()
            a, hi, lo = blobs(b, "a", np.uint16), blobs(b, "b", np.uint16), blobs(b, "c", np.uint32)
            passed = [k for k, x in enumerate(kind) if x == 1]
            if passed:
                yield b.take(pa.array(passed))
            for k, c in enumerate(b.column(1).to_pylist()):
                if kind[k] == 0:
                    owner.append(np.full(len(a[k]), len(chunks), np.int32))
                    chunks.append(c)
                    docs.append(np.cumsum(a[k], dtype=np.int64).astype(np.int32))
                    toks.append(hi[k].astype(_U) << _U(32) | lo[k])
        if not chunks:
            return
        tok = np.concatenate(toks)
        del toks, a, hi, lo, b
        order = np.argsort(tok)
        tok = tok[order]
        cut = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1], [True]]))
        many = np.diff(cut)
        keep = np.repeat(many >= 2, many)
        order, tok, df = order[keep], tok[keep], np.repeat(many, many)[keep]
        own, doc = np.concatenate(owner)[order], np.concatenate(docs)[order]
        by = np.argsort(own, kind="stable")
        own, doc, tok, df = own[by], doc[by], tok[by], df[by]
        ends = np.searchsorted(own, np.arange(len(chunks)), "right")
        rows = []
        for k, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            if lo < hi:
                rows.append(_row(chunk_target(chunks[k], parts), chunks[k], 0, doc[lo:hi].astype(np.uint16), tok[lo:hi], np.minimum(df[lo:hi], 0xFFFFFFFF).astype(np.uint32)))
            if len(rows) >= 256:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return count


_FOUND = "doc_id long, n long, s1 long, s2 long, prefix int, tokens binary, freqs binary"


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk side: a row per document; the sets whose prefix has a shared shingle carry their shared shingles, rare first."""
    got: dict[int, list[tuple]] = {}
    for b in batches:
        cols = [b.column(k) for k in range(6)]
        for k, (c, kind) in enumerate(zip(cols[1].to_pylist(), cols[2].to_pylist())):
            got.setdefault(c, []).append((kind, *(cols[j][k].as_py() for j in (3, 4, 5))))
    for c in list(got):
        rows = got.pop(c)
        info = next(r for r in rows if r[0] == 1)
        ids, none = np.frombuffer(info[1], np.int64).reshape(2, -1)
        sizes, sent = np.frombuffer(info[2], np.int64).reshape(2, -1)
        s1, s2 = np.frombuffer(info[3], np.int64).reshape(2, -1)
        back = [r for r in rows if r[0] == 0]
        doc = np.concatenate([np.frombuffer(r[1], np.uint16) for r in back] or [np.zeros(0, np.uint16)]).astype(np.int64)
        tok = np.concatenate([np.frombuffer(r[2], _U) for r in back] or [np.zeros(0, _U)])
        df = np.concatenate([np.frombuffer(r[3], np.uint32) for r in back] or [np.zeros(0, np.uint32)])
        order = np.lexsort((tok, df, doc))
        tok, df = tok[order], df[order]
        shared = np.bincount(doc, minlength=len(ids))
        prefix = sizes - least_overlap(sizes) + 1 - (sizes - shared)
        prefix = np.where((sent == 1) & (shared > 0), np.maximum(prefix, 0), 0)
        ends = np.cumsum(shared)
        blob = lambda v: pa.array([v[ends[i] - shared[i] : ends[i]].tobytes() if prefix[i] else None for i in range(len(ids))], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=none == 1), pa.array(sizes), pa.array(s1), pa.array(s2), pa.array(prefix.astype(np.int32)), blob(tok), blob(df)], ["doc_id", "n", "s1", "s2", "prefix", "tokens", "freqs"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the candidate pairs that are similar."""
    for batch in batches:
        a, b = longs(batch, "a")[0], longs(batch, "b")[0]
        na, nb = longs(batch, "na")[0], longs(batch, "nb")[0]
        ta, tb = blobs(batch, "ta", _U), blobs(batch, "tb", _U)
        ok = np.zeros(len(a), bool)
        for k in range(len(a)):
            both = np.concatenate([ta[k], tb[k]])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            ok[k] = 100 * common >= PERCENT * (na[k] + nb[k] - common)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), batch.column(batch.schema.get_field_index("single")).filter(pa.array(ok))], ["a", "b", "single"])


def scale(n: int) -> int:
    """Sizes from 4**k on, up to four times as much, are of scale k."""
    return (n.bit_length() - 1) // 2


def groups(k: int) -> int:
    """Groups of frequent shingles, and shingles by which prefixes are extended, where the smaller set is of scale k."""
    return max(1, 4**k // 4)


def set_keys(n: int, tokens: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index keys of a set of ``n`` shingles: keys, rooms, and how many keys are single shingles.

    ``tokens``: its shingles of two documents or more, in order; ``often`` flags
    the frequent ones. The room of a key is the most shingles that the set can
    share with another that first meets it there.
    """
    place = np.arange(len(tokens)) + (n - len(tokens))
    prefix = n - least_overlap(n) + 1
    rare = np.flatnonzero(~often & (place < prefix))
    keys, rooms = [mix(tokens[rare])], [n - place[rare]]
    if len(often) and (often & (place < prefix)).any():
        for k in sorted({scale(n), scale(least_overlap(n))}):  # of the smaller of two sets
            many = groups(k)
            hot = np.flatnonzero(often & (place < prefix + many))
            group = (mix(tokens[hot] ^ _U(0x452821E638D01377)) % _U(many)).astype(np.int64)
            hot = hot[np.argsort(group, kind="stable")]
            size = np.bincount(group, minlength=many)
            ends = np.repeat(np.cumsum(size), size)  # each meets the later ones of its group
            after = ends - np.arange(len(hot)) - 1
            i = np.repeat(np.arange(len(hot)), after)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
            lo, hi = np.minimum(tokens[hot[i]], tokens[hot[j]]), np.maximum(tokens[hot[i]], tokens[hot[j]])
            keys.append(mix(mix(lo * _U(0x9E3779B97F4A7C15) + mix(hi)) ^ _U(k + 1)))
            # Sets that meet under a pair share no rare shingle, and at most 1 + many up to the pair's second one.
            rooms.append(np.minimum(int(often.sum()), n - place[hot[j]] + many))
    return np.concatenate(keys), np.concatenate(rooms), len(rare)


def _indexer(frequent: int):
    """Keys of each set, and how central it is: the more its shingles are shared, as of a group of near copies the one they were made from."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for node, n, tok, freq in zip(longs(b, "node")[0].tolist(), longs(b, "n")[0].tolist(), blobs(b, "tokens", _U), blobs(b, "freqs", np.uint32)):
                keys, rooms, singles = set_keys(n, tok, freq > frequent)
                rows.append((node, n, float(np.log2(freq).sum() / n), keys.view(np.int64), rooms.astype(np.int32), singles))
            if rows:
                node, n, centre, keys, rooms, singles = zip(*rows)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v))) for v in (keys, rooms)]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(centre), *lists, pa.array(singles, pa.int32())], ["node", "n", "centre", "keys", "rooms", "singles"])

    return index


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """Classes of near-duplicate documents: doc_id, n_shingles, component_id.

    Two documents link if their sets of distinct five-word shingles have a
    Jaccard similarity of 0.75 or more; no link is lost, and component_id is the
    smallest doc_id reachable by links. A text with fewer than five words is one
    shingle; null, empty and blank texts have none and link with nothing (their
    component is their own id). Rows that repeat an id or a text are documents of
    their own with equal sets. A null doc_id stays null and names no component
    unless all its documents have none. An empty table gives an empty result;
    other columns are ignored.

    Equal sets count as one node. The nodes of an index key (a rare shingle, or a
    pair of frequent ones) are compared with one of them, the most central, in
    STARS rounds, linear in the index; then all pairs that share a key but no
    component are compared, so that a group of m similar documents costs m
    comparisons and not m squared. There, keys of many sets are cut into blocks.
    """
    return classes_and_links(docs)[0]


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The classes, and the links (a, b, single: whether they met under a single shingle) that each step found."""
    spark = docs.sparkSession
    parts = 2 * width(spark)
    sent = clean(docs, "doc_id", "text").mapInArrow(trimmed(_sender(parts)), _SENT)
    counted = sent.repartitionById(parts, F.col("target")).mapInArrow(trimmed(_counter(parts)), _SENT)
    rows = stored(counted.repartitionById(parts, F.col("target")).mapInArrow(trimmed(_select), _FOUND), "sets")

    few = rows.where("prefix > 0")
    order = Window.partitionBy("s1", "s2").orderBy("doc_id")
    nodes = stored(few.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(F.monotonically_increasing_id().alias("node"), "n", "s1", "s2", "tokens", "freqs"), "nodes")
    index = stored(nodes.select("node", "n", "tokens", "freqs").mapInArrow(trimmed(_indexer(FREQUENT)), "node long, n long, centre double, keys array<long>, rooms array<int>, singles int"), "index")
    sets = nodes.select("node", "n", "tokens")

    def posts(comps: DataFrame | None) -> DataFrame:
        """The index by key, with the components of its nodes."""
        own = index.withColumn("component", F.col("node")) if comps is None else index.join(comps, "node")
        own = own.select("node", "n", "centre", "component", "singles", F.posexplode(F.arrays_zip("keys", "rooms")).alias("at", "k"))
        return own.select(F.col("k.keys").alias("key"), F.col("k.rooms").alias("room"), "node", "n", "centre", "component", (F.col("at") < F.col("singles")).alias("single"))

    def similar(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
        return both.mapInArrow(trimmed(_verify), "a long, b long, single boolean")

    def untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
        pairs = pairs.groupBy("a", "b").agg(F.max("single").alias("single"))
        return stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")

    def possible(na: str, nb: str, room: Column) -> Column:
        """Sizes are close, and no fewer shingles can be common than a similar pair has."""
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT) & (room * (100 + PERCENT) >= (F.col(na) + F.col(nb)) * PERCENT)

    def classes_of(links: list[DataFrame]) -> DataFrame:
        every = links[0]
        for x in links[1:]:
            every = every.union(x)
        near = connected_components(every, "a", "b")
        return stored(nodes.select("node").join(near, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")

    def still_open(now: DataFrame) -> DataFrame:
        """Keys that join several components, with their most frequent one and how many nodes they have."""
        by = now.groupBy("key", "component").agg(F.count("*").alias("m"))
        return by.groupBy("key").agg(F.max(F.struct("m", "component")).alias("_most"), F.count("*").alias("_many"), F.sum("m").alias("_all")).where("_many > 1").select("key", F.col("_most.component").alias("main"), F.col("_all").alias("all"))

    links: list[DataFrame] = []
    tried = comps = None
    for k in range(STARS):
        now = posts(comps)
        if k:
            now = now.join(still_open(now).select("key"), "key")
        chosen = F.col("centre") if k == 0 else F.xxhash64("component", F.lit(k)).cast("double")
        best = now.groupBy("key").agg(F.max(F.struct(chosen.alias("h"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("room").alias("ra"))).alias("p"), F.count("*").alias("m")).where("m > 1").select("key", "p.a", "p.na", "p.ca", "p.ra")
        met = now.join(best, "key").where((F.col("component") != F.col("ca")) & possible("n", "na", F.least("ra", "room")))
        pairs = untried(met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), "single"), tried)
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.union(pairs)
        links.append(stored(similar(pairs), "links"))
        comps = classes_of(links)

    now = posts(comps)
    now = stored(now.join(still_open(now), "key").select("key", "room", "node", "n", "component", "single", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")), "open")
    if not now.isEmpty():
        # Of a key's components, the largest needs no pairs of its own: the others meet it and each other, block by block.
        l = now.where("component <> main").select("key", "main", "single", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("room").alias("ra"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        r = now.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("room").alias("rb"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
        meets = l.join(r, ["key", "block"]).where("ca <> cb AND (cb = main OR a < b)").where(possible("na", "nb", F.least("ra", "rb")))
        pairs = untried(meets.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "single"), tried)
        found = stored(similar(pairs), "links")
        if not found.isEmpty():
            links.append(found)
            comps = classes_of(links)
    if comps is None:
        comps = nodes.select("node", F.col("node").alias("component"))

    least = stored(rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "distinct")
    classes = nodes.select("node", "s1", "s2").join(comps, "node").join(least, ["s1", "s2"])
    smallest = classes.groupBy("component").agg(F.min("least_id").alias("class_id"))
    classes = classes.join(smallest, "component").select("s1", "s2", "class_id")
    named = least.join(classes, ["s1", "s2"], "left").select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), F.coalesce("class_id", "least_id").alias("class_id"), "copies")
    # The sets of many documents are few: their classes go to every task; the others are joined by set.
    all_rows = least.agg(F.sum("copies")).first()[0] or 0
    named = stored(named, "named")
    hot = named.where(F.col("copies") > max(1, HOT * all_rows)).select("_1", "_2", F.col("class_id").alias("_hot"), F.lit(True).alias("_is"))
    own = rows.select("doc_id", "n", "s1", "s2").join(F.broadcast(hot), (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2")), "left").drop("_1", "_2")
    alone = F.col("_is").isNull() & (F.col("n") > 0)
    own = own.select("doc_id", "n", "_hot", F.when(alone, F.col("s1")).otherwise(F.xxhash64("doc_id")).alias("s1"), F.when(alone, F.col("s2")).otherwise(F.lit(0)).alias("s2"), (~alone).cast("int").alias("_off"))
    on = (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2")) & (F.col("_off") == F.col("_on"))
    out = own.join(named.select("_1", "_2", "class_id", F.lit(0).alias("_on")), on, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_hot", "class_id", "doc_id").alias("component_id")), links


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t(a, b) AS (SELECT r, r FROM d UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b),
m AS (SELECT t.a AS r, min(doc_id) AS component_id FROM t JOIN d ON d.r = t.b GROUP BY t.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""
