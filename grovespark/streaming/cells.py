"""Cell statistics of a stream of points, in event-time windows under a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from grovespark.functions.geometry import quad_cell


def windowed_density(points: DataFrame, axes: Sequence[str], side: float, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Points and their sums of axes for each window of ``ts`` and cell; rows later than the watermark are left out."""
    cells = quad_cell(axes, [F.lit(0.0)] * len(axes), F.lit(side))
    x = points.withWatermark("ts", late) if points.isStreaming else points
    x = x.select("ts", *axes, *[v.alias(f"c{a}") for v, a in zip(cells, axes)])
    out = x.groupBy(F.window("ts", every).alias("w"), *[f"c{a}" for a in axes]).agg(F.count("*").alias("n"), *[F.sum(a).alias(f"sum_{a}") for a in axes])
    return out.select(F.col("w.start").alias("start"), *[f"c{a}" for a in axes], "n", *[f"sum_{a}" for a in axes])
