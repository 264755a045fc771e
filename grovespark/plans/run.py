"""Whole runs: read points, build the tree, write the solution and statistics. ``python -m grovespark.plans.run MODE DATA OUT``."""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from grovespark.operators.emst import emst, emst_summary, forest_rounds
from grovespark.sources.text import read_points, write_links

MODES = ("eval", "run", "forest")


def solve(points: DataFrame, axes: tuple[str, ...], rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, summary) of the tree, or of the forest after ``rounds`` rounds."""
    edges = emst(points, axes)
    if rounds is not None:
        kept, _ = forest_rounds(edges.withColumn("d2", F.col("length") * F.col("length")), points.select(F.col("id").alias("node")), rounds)
        edges = edges.join(kept.select("src", "dst"), ["src", "dst"], "left_semi")
    return edges, emst_summary(edges)


def run(spark: SparkSession, mode: str, data: str, out: str, rounds: int = 1) -> DataFrame:
    """``run``: the whole tree; ``forest``: after some rounds; ``eval``: size and length of the links that ``out`` has."""
    points = read_points(spark, data)
    axes = tuple(a for a in "xyz" if a in points.columns)
    began = time.time()
    if mode == "eval":
        edges = spark.read.parquet(f"{out}/edges")
    else:
        edges, _ = solve(points, axes, rounds if mode == "forest" else None)
        edges.write.mode("overwrite").parquet(f"{out}/edges")
        edges = spark.read.parquet(f"{out}/edges")
        low = points.agg(F.min("id")).first()[0] or 0
        write_links(edges.select((F.col("src") - low).alias("src"), (F.col("dst") - low).alias("dst")), points.select((F.col("id") - low).alias("id")), f"{out}/links-{int(began)}")
    return emst_summary(edges).withColumn("seconds", F.lit(time.time() - began))


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), *sys.argv[1:4]).show()
