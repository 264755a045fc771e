"""Sharding (6): jump consistent hashing of stable keys, and gapless slots in each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grovespark.llm.frames import clean, documents, placed
from grovespark.llm.textops import longs, mix

SHARDS = 40


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key by jump consistent hashing (Lamping and Veach): no ring table.

    Each key jumps ahead through the shard counts at which it would move, so
    with one shard more only the keys whose last jump lands there move.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    at, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put every document into a shard by the law ``key``: doc_id and shard count decide.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law,
    shard, slot (gapless from 0 in each shard, by doc_id) and grown_shard (with
    one shard more). A null text is empty (size 16, crc32 0); a null doc_id has
    the key 0; repeated rows share a shard and take slots of their own. An empty
    table gives an empty result; other columns are ignored. Texts never leave
    the JVM, and a shard's slots are numbered bucket by bucket.
    """

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = mix(longs(b, "doc_id")[0].view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(jump(key, shards), pa.int32()), pa.array(jump(key, shards + 1), pa.int32())], [*b.schema.names, "shard", "grown_shard"])

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = clean(docs, "doc_id", "text").select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    dealt = sized.mapInArrow(to_shards, "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    out = placed(dealt, ["shard"], ["doc_id", "text_crc32", "size"], name="slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
