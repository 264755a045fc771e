"""DataFrame building blocks of the operators: held-out folds, sums of dense tables, numbering without one-task windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from grovespark.runtime import stored, width


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(n: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``; -1 where the id is null, so that such rows are never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def summed(parts: DataFrame, kind, blocks: int) -> np.ndarray:
    """Sum dense tables of whole numbers that tasks emit as rows ``(block int, part binary)``, as 64-bit numbers, so in any order.

    Each block is summed as it streams by, so a task holds one block however
    many tables there are; the driver gets one table of fixed size.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(x.as_buffer(), kind)
                if k in total:
                    total[k] += v
                else:
                    total[k] = v.astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "part"])

    salted = parts.repartition(blocks, F.col("block")).mapInArrow(add, "block int, part binary")
    got: dict[int, np.ndarray] = {}
    for r in salted.toLocalIterator():
        v = np.frombuffer(r.part, np.int64)
        got[r.block] = got[r.block] + v if r.block in got else v
    return np.concatenate([got[k] for k in range(blocks)]) if got else np.zeros(0, np.int64)


def placed(df: DataFrame, group: list[str], order: list[str], value: Column | None = None, name: str = "place") -> DataFrame:
    """Add ``name``: the sum of ``value`` (1 if None: a gapless index) over the rows before it in its group.

    A group is cut by a hash of the order columns into as many buckets as the
    shuffle has partitions, so that a group with a third of all rows is spread
    over them all; bucket totals, summed first in the map tasks, give each
    bucket its start. Rows equal in all order columns are interchangeable.
    """
    n = width(df.sparkSession)
    x = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int")).withColumn("_value", F.lit(1).cast("long") if value is None else value.cast("long"))
    sums = x.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    on = F.col("_bucket") == F.col("_b")
    for c in same:
        on = on & c
    y = x.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return y.join(starts, on, "left").withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_bucket", "_value", "_inside", "_b", "_start", *[f"_g{i}" for i in range(len(group))])


_KINDS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "_row": "long"}


def _numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Columns renamed by place, so that names that clash (in upper and lower case, say) can be told apart."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def _own(df: DataFrame, names: list[str], n: str) -> Column:
    return (F.col(names[df.columns.index(n)]) if n in df.columns else F.lit(None)).cast(_KINDS[n]).alias(n)


def clean(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the named columns; missing ones come as null. Extra columns, clashing names included, play no part."""
    x, names = _numbered(df)
    return x.select(*[_own(df, names, n) for n in wanted])


def carried(df: DataFrame, *wanted: str) -> DataFrame:
    """The named columns, and the whole row as a struct ``document`` that :func:`released` gives back."""
    x, names = _numbered(df)
    return x.select(*[_own(df, names, n) for n in wanted], F.struct(*names).alias("document"))


def rows_of(df: DataFrame, *wanted: str) -> DataFrame:
    """As :func:`carried`, with ``_row``: a number of the row itself, from its file and place, the same wherever the table is read.

    A frame that is not a table of files is written as one first.
    """
    x, names = _numbered(df)
    try:
        at = df.metadataColumn("_metadata")
        x = df.select("*", F.xxhash64(at["file_path"], at["row_index"]))
    except AnalysisException:
        x = stored(x, "rows")
        at = x.metadataColumn("_metadata")
        x = x.select("*", F.xxhash64(at["file_path"], at["row_index"]))
    return x.toDF(*names, "_row").select(*[_own(df, names, n) for n in wanted], "_row", F.struct(*names).alias("document"))


def released(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select("document.*").toDF(*like.columns)


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int, train: Column) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``most`` labelled training documents, those with the smallest hash of their id.

    Rows without an id or a label don't count; an id labelled twice has the
    greater label. The bound on the labels is the bound of their broadcast.
    """
    few = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(train)
    few = few.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return clean(docs, "doc_id", "text").join(F.broadcast(few), "doc_id")
