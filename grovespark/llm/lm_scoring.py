"""LM scoring (2): a word-count base and a causal self-attention model over every whole text.

Texts are lowered and coded once, into a table of chunks in the shared folder:
a row has the documents of some megabytes of text, their subword ids, and their
words as numbers in the chunk's own dictionary. Word counts of the corpus come
from one exchange of the dictionaries, in which a word has one entry a chunk,
however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from grovespark.llm import lm_graph, lm_model as lm
from grovespark.llm.frames import clean, documents, fold, summed
from grovespark.llm.textops import LOWER, Slice, blobs, longs, mix, roomy, slices, strings, table_rows, trimmed
from grovespark.llm.tokens import coder, default_path
from grovespark.runtime import stored, width

FOLDS, HELD = 7, 2
CHUNK = 6 << 20
#: Every window of every training text moves the weights in one of the rounds.
ROUNDS, BATCH, RATE = 2, 64, 4e-3
#: Windows scored at once; weights are summed as whole numbers of this part, so that sums don't depend on order.
BLOCK, GRAIN = 64, 2.0**-20
_U = np.uint64

#: A chunk is a row group of its own, so that a file's chunks can be dealt to several tasks.
ONE_ROW = {"parquet.block.row.count.limit": 1, "compression": "zstd"}
_CODED = "chunk long, docs binary, hashes binary, place binary, counts binary, words binary, rare binary, sizes binary, ids binary"
_CODED_NAMES = [x.split()[0] for x in _CODED.split(", ")]


def _row(names: list[str], *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) if isinstance(v, int) else pa.array([v.tobytes()], pa.binary()) for v in values], names)


def _docs(blob: np.ndarray) -> np.ndarray:
    """Rows: doc_id, whether it is null, whether it is held out, words of the text."""
    return blob.reshape(4, -1)


def coded(docs: DataFrame, path: str) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        own = coder(path)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            info, words, sizes, ids = (np.concatenate([h[k] for h in held], axis=-1) for k in range(4))
            train = np.repeat(info[2] == 0, info[3])
            hashes, number, often = np.unique(words, return_inverse=True, return_counts=True)
            counts = np.bincount(number[train], minlength=len(hashes))
            # The frequent words of a chunk get the small numbers, two bytes each; rarer ones an escape and four bytes.
            rank = np.empty(len(hashes), np.int64)
            rank[np.argsort(-often, kind="stable")] = np.arange(len(hashes))
            number = rank[number]
            order = np.argsort(rank)  # hash place of each rank
            rare = number >= 0xFFFF
            return _row(_CODED_NAMES, chunk, info, hashes, order.astype(np.uint32), counts.astype(np.int32), np.where(rare, 0xFFFF, number).astype(np.uint16), number[rare].astype(np.uint32), sizes.astype(np.int32), ids.astype(np.uint16))

        for b in batches:
            doc, none = longs(b, "doc_id")
            out = b.column(2).to_numpy(zero_copy_only=False)
            for s in slices(strings(b)):
                low = Slice(s.lo, s.hi, LOWER[s.data], s.offs)
                w = low.words()
                words = w.hashes()
                ids, sizes = own.encode(low, w)
                k = slice(s.lo, s.hi)
                held.append((np.stack([doc[k], none[k].astype(np.int64), out[k].astype(np.int64), w.counts]), words, sizes, ids))
                size += len(s.data)
                if size >= CHUNK:
                    yield flush()
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield flush()

    return stored(clean(docs, "doc_id", "text").select("doc_id", "text", (fold(FOLDS) == HELD).alias("held_out")).mapInArrow(trimmed(code), _CODED), "coded", **ONE_ROW)


_PART = "bucket int, chunk long, a binary, b binary"


def word_totals(chunks: DataFrame) -> DataFrame:
    """For each chunk and bucket of hashes, the corpus counts of the chunk's words; and each bucket's training tokens and distinct words.

    Ends are not among these words: there is one for each training text.
    """
    parts = width(chunks.sparkSession)
    names = ["bucket", "chunk", "a", "b"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, h, c in zip(b.column(0).to_pylist(), blobs(b, "hashes", _U), blobs(b, "counts", np.int32)):
                cut = np.searchsorted(((h >> _U(32)) * _U(parts)) >> _U(32), np.arange(parts + 1).astype(_U))
                some = np.flatnonzero(np.diff(cut))
                cells = [(k, chunk, h[cut[k] : cut[k + 1]].tobytes(), c[cut[k] : cut[k + 1]].tobytes()) for k in some.tolist()]
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for k, chunk, h, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), blobs(b, "a", _U), blobs(b, "b", np.int32)):
                held.setdefault(k, []).append((chunk, h, c))
        for k, rows in held.items():
            words, number = np.unique(np.concatenate([h for _, h, _ in rows]), return_inverse=True)
            counts = np.bincount(number, np.concatenate([c for _, _, c in rows]), len(words)).astype(np.int64)
            back = np.split(counts[number], np.cumsum([len(h) for _, h, _ in rows])[:-1])
            cells = [(k, chunk, c.tobytes(), b"") for (chunk, _, _), c in zip(rows, back)]
            cells.append((k, -1, np.array([counts.sum(), (counts > 0).sum()]).tobytes(), b""))
            for lo in range(0, len(cells), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells[lo : lo + 64]), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names)

    return stored(chunks.select("chunk", "hashes", "counts").mapInArrow(trimmed(send), _PART).repartitionById(parts, F.col("bucket")).mapInArrow(trimmed(total), _PART), "totals")


def base_scores(chunks: DataFrame) -> DataFrame:
    """chunk, place, doc_id, held_out, n_tokens, n_known, train_tokens, base_score of each document."""
    totals = word_totals(chunks)
    tokens, distinct = np.sum([np.frombuffer(r.a, np.int64) for r in totals.where("chunk = -1").select("a").toLocalIterator()] or [[0, 0]], axis=0).tolist()

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int((_docs(d)[2] == 0).sum()) for b in batches for d in blobs(b, "docs", np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    ends = chunks.select("docs").mapInArrow(trimmed(trained), "n long").agg(F.sum("n")).first()[0] or 0
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    divisor = np.log10(tokens + distinct + 1)
    parts = width(chunks.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for b in batches:
            for chunk, k, a, w, r, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(blobs(b, n, np.uint8) for n in ("a", "b", "c", "d"))):
                own = held.setdefault(chunk, {})
                if k < 0:
                    own["docs"] = a.view(np.int64), w.view(np.uint16), r.view(np.uint32), h.view(np.uint32)
                else:
                    own[k] = a.view(np.int64)
        for chunk in list(held):
            own = held.pop(chunk)
            info, word, rare, place = own.pop("docs")
            info = _docs(info)
            counts = np.concatenate([own[k] for k in sorted(own)] or [np.zeros(0, np.int64)])[place]
            number = word.astype(np.int64)
            number[word == 0xFFFF] = rare
            c = counts[number]
            add = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], np.cumsum(info[3])])])
            n = info[3] + 1
            base = add(np.log10(c + 1)) + np.log10(ends + 1) - n * divisor
            m = info.shape[1]
            out = [pa.array(np.full(m, chunk)), pa.array(np.arange(m, dtype=np.int32)), pa.array(info[0], pa.int64(), mask=info[1] == 1), pa.array(info[2] == 1), pa.array(n), pa.array(add(c > 0) + int(ends > 0)), pa.array(np.full(m, tokens)), pa.array(base)]
            yield pa.RecordBatch.from_arrays(out, ["chunk", "place", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"])

    left = chunks.select("chunk", F.lit(-1).alias("bucket"), F.col("docs").alias("a"), F.col("words").alias("b"), F.col("rare").alias("c"), F.col("place").alias("d"))
    right = totals.where("chunk <> -1").select("chunk", "bucket", "a", *[F.lit(b"").alias(x) for x in "bcd"])
    return left.union(right).repartition(parts, F.col("chunk")).mapInArrow(trimmed(score), "chunk long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """chunk, documents, ids of each text and their ids."""
    for b in batches:
        for chunk, d, n, ids in zip(b.column(0).to_pylist(), blobs(b, "docs", np.int64), blobs(b, "sizes", np.int32), blobs(b, "ids", np.uint16)):
            yield chunk, _docs(d), n.astype(np.int64), ids.astype(np.int64)


def _some(sizes: np.ndarray, ids: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` ids."""
    ends, lo, at = np.cumsum(sizes), 0, 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, at + most, "right")))
        yield slice(lo, hi), sizes[lo:hi], ids[at : int(ends[hi - 1])]
        lo, at = hi, int(ends[hi - 1])


def turns(windows: int, chunk: int, first: int, turn: int) -> np.ndarray:
    """The windows of round ``turn``, shuffled; each window is in one round."""
    salt = mix(np.array([chunk * 4099 + first]).astype(_U))[0]
    order = np.argsort(mix(np.arange(windows).astype(_U) ^ salt), kind="stable")
    return order[turn::ROUNDS]


def _sparse(at: np.ndarray, many: np.ndarray) -> bytes:
    """Places and counts, four bytes each; counts beyond that as several entries."""
    part = np.concatenate([at, np.repeat(at, many >> 31)]).astype(np.uint32)
    rest = np.concatenate([many & 0x7FFFFFFF, np.full(len(part) - len(at), 1 << 31)]).astype(np.uint32)
    return np.concatenate([part, rest]).tobytes()


def _dense(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, many = np.frombuffer(blob, np.uint32).reshape(2, -1).astype(np.int64)
    own, back = np.unique(at, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, back, many)
    return own, total


def bigrams(chunks: DataFrame, known: lm.Ids) -> np.ndarray:
    """Counts (INPUTS, COLUMNS) of the columns after each input row, over all training texts; tasks send what they saw."""
    size, blocks = lm.INPUTS * lm.COLUMNS, 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, docs, sizes, ids in _texts(batches):
            fit = docs[2] == 0
            for _, n, own in _some(sizes[fit], ids[np.repeat(fit, sizes)]):
                text = lm.padded(own, n)[1:]
                opens = np.zeros(len(text), bool)
                opens[np.cumsum(n + 2) - (n + 2)] = True
                after = np.flatnonzero(~opens[1:]) + 1
                at, many = np.unique(known.row[text[after - 1]].astype(np.int64) * lm.COLUMNS + known.column[text[after]], return_counts=True)
                total[at] += many
        at = np.flatnonzero(total)
        cut = np.searchsorted(at, np.arange(1, blocks) * (size // blocks))
        rows = [(k, _sparse(a, total[a])) for k, a in enumerate(np.split(at, cut)) if len(a)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], ["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), blobs(b, "part", np.uint8)):
                at, many = _dense(part)
                held.setdefault(k, np.zeros(size // blocks, np.int64))[at - k * (size // blocks)] += many
        for k, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_sparse(at + k * (size // blocks), total[at])], pa.binary())], ["block", "part"])

    total = np.zeros(size, np.int64)
    sums = chunks.mapInArrow(trimmed(count), "block int, part binary").repartitionById(blocks, F.col("block")).mapInArrow(trimmed(add), "block int, part binary")
    for r in sums.toLocalIterator():  # a table of fixed size
        at, many = _dense(np.frombuffer(r.part, np.uint8))
        total[at] = many
    return total.reshape(lm.INPUTS, lm.COLUMNS)


def train(chunks: DataFrame) -> tuple[lm.Ids, lm.Tables, dict[str, np.ndarray]]:
    """Statistics over all training texts, then rounds of weights learned by every task and averaged."""
    own = chunks.select("chunk", "docs", "sizes", "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(lm.VOCAB, np.int64)
        for _, docs, sizes, ids in _texts(batches):
            fit = docs[2] == 0
            total += np.bincount(ids[np.repeat(fit, sizes)], minlength=lm.VOCAB)
            total[lm.END] += int(fit.sum())
        yield table_rows(total, 16)

    got = summed(own.mapInArrow(trimmed(count), "block int, part binary"), np.int64, 16)
    known = lm.ids_of(got if len(got) else np.zeros(lm.VOCAB, np.int64))
    tables = lm.tables(known, bigrams(own, known))
    params = lm.start()
    row, cls, pairs = known.row.astype(np.int64), tables.cls.astype(np.int64), tables.pairs
    for turn in range(ROUNDS):
        now = params

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            roomy()
            adam = lm.Adam({k: v.copy() for k, v in now.items()}, RATE / (1 + turn))
            left, seen = [], 0  # windows short of a batch

            def step(windows: list[np.ndarray], last: bool = False) -> list[np.ndarray]:
                rows, aims, valid = windows
                end = len(rows) if last else len(rows) // BATCH * BATCH
                for lo in range(0, end, BATCH):
                    k = slice(lo, min(lo + BATCH, end))
                    adam.move(lm_graph.gradients(adam.p, pairs, rows[k], aims[k], valid[k]))
                return [w[end:] for w in windows]

            for chunk, docs, sizes, ids in _texts(batches):
                fit = docs[2] == 0
                ids, sizes = ids[np.repeat(fit, sizes)], sizes[fit]
                for part, n, own_ids in _some(sizes, ids):
                    inputs, aims, _ = lm.windows(n)
                    pick = turns(len(inputs), chunk, part.start, turn)
                    inputs, aims = inputs[pick], aims[pick]
                    text = lm.padded(own_ids, n)
                    rows = row[text]
                    rows[0] = lm.PAD
                    more = [rows[inputs], cls[text[aims]], aims > 0]
                    left = step([np.concatenate(w) for w in zip(left, more)] if left else more)
                    seen += len(inputs)
            if seen:
                step(left, last=True)
            weights = np.append(lm.flat(adam.p).astype(np.float64) * seen, float(seen))
            yield table_rows(np.rint(weights / GRAIN).astype(np.int64), 16)

        got = summed(own.mapInArrow(trimmed(learn), "block int, part binary"), np.int64, 16)
        if len(got) and got[-1] > 0:
            params = lm.unflat(got[:-1] / got[-1])
    return known, tables, params


def log_scores(known: lm.Ids, tables: lm.Tables, params: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each text, its ids and one end."""
    total = np.zeros(len(sizes))
    for part, n, own in _some(sizes, ids):
        text = lm.padded(own, n)
        rows, cls = known.row.astype(np.int64)[text], tables.cls.astype(np.int64)[text]
        rows[0] = lm.PAD
        column = np.minimum(known.column[text], lm.HEAD)
        share = tables.share[text] + tables.inner[np.roll(rows, 1), column]  # of an id in its class, after the id before it
        inputs, aims, of = lm.windows(n)
        each = np.zeros(len(inputs))
        for lo in range(0, len(inputs), BLOCK):
            k = slice(lo, lo + BLOCK)
            aim = aims[k]
            logs = lm_graph.log_classes(params, tables.pairs, rows[inputs[k]], cls[aim]) + share[aim]
            each[k] = np.where(aim > 0, logs, 0).sum(1, dtype=np.float64)
        total[part] = np.bincount(of, each, len(n))
    return total


def model_scores(chunks: DataFrame) -> DataFrame:
    """chunk, place, score of each document."""
    shared = chunks.sparkSession.sparkContext.broadcast(train(chunks))  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy()
        for chunk, docs, sizes, ids in _texts(batches):
            total, m = log_scores(*shared.value, ids, sizes), len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.array(np.arange(m, dtype=np.int32)), pa.array(total / np.log(10)), pa.array(sizes + 1)], ["chunk", "place", "score", "n_subwords"])

    return chunks.select("chunk", "docs", "sizes", "ids").mapInArrow(trimmed(score), "chunk long, place int, score double, n_subwords long")


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Score every whole text, A-Z lowered: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords.

    base_score and the counts are those of words and one end per text under
    add-one smoothing; score is the log10 probability of the text's subword ids
    and one end under the attention model. A null text is empty: its one token is
    the end. A null doc_id is scored and not held out; rows that repeat a text
    agree and count each for itself. An empty table gives an empty result; other
    columns are ignored. Words are told apart by 64-bit hashes.
    """
    chunks = coded(docs, path or default_path())
    base = base_scores(chunks)
    model = model_scores(chunks).select(F.col("chunk").alias("_c"), F.col("place").alias("_p"), "score", "n_subwords")
    both = base.join(model, (F.col("chunk") == F.col("_c")) & (F.col("place") == F.col("_p")))
    return both.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords")


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
