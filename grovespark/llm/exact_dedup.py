"""Exact dedup (3): a cuckoo-filter index of live digests, partitioned by digest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from grovespark.llm.frames import clean, documents
from grovespark.llm.textops import trimmed
from grovespark.runtime import stored, width

NULL_ID = (1 << 63) - 1


class CuckooIndex:
    """Live digests under a cuckoo filter.

    The filter has two candidate buckets of ``SLOTS`` one-byte fingerprints for
    each digest; the other bucket follows from one bucket and the fingerprint
    alone, so entries move without their digest. Beside each fingerprint stands
    the digest it came from and a value: a filter hit is verified against that
    stored content, so a false positive costs one comparison and never a row.
    If an insertion still has no room after ``KICKS`` moves, the filter doubles
    and is refilled from the stored digests.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1 << 8):
        self.buckets = 1 << max(2, (buckets - 1).bit_length())
        self.size = self.resizes = 0
        self._clear()

    def _clear(self) -> None:
        self.prints: list[bytearray] = [bytearray() for _ in range(self.buckets)]
        self.content: list[list[tuple[bytes, object]]] = [[] for _ in range(self.buckets)]

    def _where(self, digest: bytes) -> tuple[int, int, int]:
        mark = digest[0] or 1
        first = int.from_bytes(digest[8:16], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        mark, *both = self._where(digest)
        for b in both:
            k = self.prints[b].find(mark)
            while k >= 0:  # a hit of the filter: verify
                if self.content[b][k][0] == digest:
                    return b, k
                k = self.prints[b].find(mark, k + 1)
        return None

    def get(self, digest: bytes, default=None):
        found = self._find(digest)
        return self.content[found[0]][found[1]][1] if found else default

    def delete(self, digest: bytes) -> bool:
        """Take a live digest out; False if it isn't there."""
        if not (found := self._find(digest)):
            return False
        b, k = found
        del self.prints[b][k], self.content[b][k]
        self.size -= 1
        return True

    def insert(self, digest: bytes, value) -> None:
        """Add a digest, or replace the value of a live one."""
        if found := self._find(digest):
            self.content[found[0]][found[1]] = (digest, value)
            return
        self.size += 1
        self._place(digest, value)

    def _place(self, digest: bytes, value) -> None:
        mark, b, other = self._where(digest)
        if len(self.prints[b]) >= self.SLOTS and len(self.prints[other]) < self.SLOTS:
            b = other
        for kick in range(self.KICKS):
            if len(self.prints[b]) < self.SLOTS:
                self.prints[b].append(mark)
                self.content[b].append((digest, value))
                return
            k = kick % self.SLOTS
            mark, self.prints[b][k] = self.prints[b][k], mark
            (digest, value), self.content[b][k] = self.content[b][k], (digest, value)
            b = self._other(b, mark)
        self._resize([(digest, value)])

    def _resize(self, more: list[tuple[bytes, object]]) -> None:
        kept = [x for bucket in self.content for x in bucket] + more
        self.buckets *= 2
        self.resizes += 1
        self._clear()
        for digest, value in kept:
            self._place(digest, value)

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.content:
            yield from bucket


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def index_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge rows (digest, keep_id, keep_row, group_size) of one partition into one row a digest."""
    index = CuckooIndex()
    for b in batches:
        for digest, doc, row, n in zip(*(c.to_pylist() for c in b.columns)):
            now = index.get(digest)
            if now is None:
                index.insert(digest, (doc, row, n))
            elif (doc, row) < now[:2]:  # an earlier row stays instead: the live entry goes
                index.delete(digest)
                index.insert(digest, (doc, row, n + now[2]))
            else:
                index.insert(digest, (*now[:2], n + now[2]))
    rows = list(index.items())
    for lo in range(0, len(rows), 10_000):
        part = rows[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.binary()), *[pa.array([v[k] for _, v in part], pa.int64()) for k in range(3)]], ["digest", "keep_id", "keep_row", "group_size"])


_INDEXED = "digest binary, keep_id long, keep_row long, group_size long"


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Find equal texts; of each group the row with the smallest doc_id stays.

    Returns one row per document: doc_id, keep_id, group_size, kept and
    text_sha256 (of the normalised text). A null text is empty, so null, empty
    and missing texts form one group (white space alone is one space, another
    text). A null doc_id comes after all others. Of rows that repeat a doc_id
    and a text, one is kept. An empty table gives an empty result; other columns
    are ignored.

    Every map task indexes its own digests first, so a group with a third of all
    rows reaches the task of its digest as one row per map task.
    """
    spark = docs.sparkSession
    rows = stored(clean(docs, "doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest")), "digests")
    own = rows.select("digest", F.coalesce("doc_id", F.lit(NULL_ID)).alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    groups = own.mapInArrow(trimmed(index_digests), _INDEXED).repartition(width(spark), "digest").mapInArrow(trimmed(index_digests), _INDEXED)
    joined = rows.join(groups.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"))
    return joined.select("doc_id", F.nullif("keep_id", F.lit(NULL_ID)).alias("keep_id"), "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
     g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""
