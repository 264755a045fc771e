"""A corpus pipeline of five stages: rules, exact dedup, near-duplicate join, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from grovespark.llm.exact_dedup import exact_dedup, normalised
from grovespark.llm.frames import carried, documents, released, rows_of
from grovespark.llm.mixing import copies
from grovespark.llm.ngram_join import jaccard_classes
from grovespark.llm.packing import pack
from grovespark.llm.quality_rules import quality_rules
from grovespark.runtime import stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trusted target is the documents labelled good."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return released(quality_rules(docs, trusted, carry=True).where("kept"), docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id."""
    result = stored(exact_dedup(docs), "dedup")
    kept = result.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    marked = carried(docs, "doc_id", "text").withColumn("_text", F.sha2(normalised(F.col("text")).cast("binary"), 256))
    out = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha")), "left_semi")
    again = result.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("text_sha256").count().where("count > 1").select(F.col("text_sha256").alias("_sha"))
    if not again.isEmpty():  # rows that repeat both id and text
        same = F.col("_text") == F.col("_sha")
        out = out.join(again, same, "left_anti").union(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "_text"]))
    return released(out, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id; null ids come last, and one of several rows with that id stays."""
    rows = rows_of(docs, "doc_id", "text")
    classes = jaccard_classes(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    kept = classes.join(rows.select("_row", "doc_id"), "_row").groupBy("_class").agg(first).select(F.col("first._row").alias("_row"))
    return released(rows.join(kept, "_row", "left_semi"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words; what is left of a time is drawn evenly over lengths."""
    rows = rows_of(docs, "doc_id", "source", "text")
    taken = copies(rows.select("doc_id", "source", "text", "_row")).select("_row", "times")
    return released(rows.select("_row", "document").join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in training sequences."""
    return pack(docs)


STAGES = [("quality_rules", rules), ("exact_dedup", dedup), ("ngram_jaccard_join", near), ("mixing", mixed), ("best_fit_packing", packed)]

#: The ratio of hashed n-grams, the seeded permutations and the subword ids have no SQL; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
