"""Windows over grid positions (i, j): filters, masks, lookups and objective terms of images kept as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from grovespark.functions.geometry import mirror


def ring_offsets(topology: str, reach: int) -> list[tuple[int, int, int]]:
    """(ring, di, dj) up to a reach: ``quad`` rings are squares, ``tetra`` diamonds, ``hexa`` hexagons in axial coordinates."""
    far = {"quad": lambda i, j: max(abs(i), abs(j)), "tetra": lambda i, j: abs(i) + abs(j), "hexa": lambda i, j: max(abs(i), abs(j), abs(i + j))}[topology]
    span = range(-reach, reach + 1)
    return sorted((far(i, j), i, j) for i in span for j in span if far(i, j) <= reach)


def _offsets(offsets: Sequence[tuple]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(float(w)).alias("w")) for i, j, w in offsets])


def shifted(grid: DataFrame, offsets: Sequence[tuple[int, int, float]], values: Sequence[str], size: tuple[int, int] | None = None) -> DataFrame:
    """Each position with the values (n_*) at its offsets (di, dj, weight w); with ``size``, borders are mirrored, else missing rows are left out."""
    x = grid.select("*", F.explode(_offsets(offsets)).alias("o")).select("*", "o.di", "o.dj", "o.w").drop("o")
    ni, nj = F.col("i") + F.col("di"), F.col("j") + F.col("dj")
    if size:
        ni, nj = mirror(ni, size[0]), mirror(nj, size[1])
    side = grid.select(F.col("i").alias("_ni"), F.col("j").alias("_nj"), *[F.col(v).alias(f"n_{v}") for v in values])
    return x.withColumns({"_ni": ni, "_nj": nj}).join(side, ["_ni", "_nj"]).drop("_ni", "_nj")


def _square(radius: int, centre: bool = True) -> list[tuple[int, int, float]]:
    return [(i, j, 1.0) for _, i, j in ring_offsets("quad", radius) if centre or i or j]


def edge4(grid: DataFrame) -> DataFrame:
    """Sum of absolute differences to the 4 neighbours."""
    near = shifted(grid, [(1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)], ["v"])
    return near.groupBy("i", "j").agg(F.sum(F.abs(F.col("n_v") - F.col("v"))).alias("edge"))


def padded(grid: DataFrame, reach: int, values: Sequence[str], size: tuple[int, int] | None = None) -> DataFrame:
    """The grid's values at all places (i, j) at most ``reach`` from its box that a window reads: with ``size``, borders are mirrored."""
    box = _box(grid, F.col)
    out = grid.select("i", "j", *values).where("i IS NOT NULL AND j IS NOT NULL")
    for a, n in zip("ij", size or ()):
        p = F.col(a)  # the places that mirror to p: itself, -p below 0, 2n - 2 - p from n on
        images = F.array(F.when((p >= 0) & (p < n), p), F.when(p > 0, -p), F.when(2 * n - 2 - p >= n, 2 * n - 2 - p))
        out = out.withColumn(a, F.explode(images)).where(F.col(a).between(box[a][0] - reach, box[a][1] + reach))
    return out


def _box(grid: DataFrame, at: Callable[[str], Column]) -> dict[str, tuple[int, int]]:
    """Least and greatest value of i and j; 0 for no rows."""
    r = grid.agg(*[f(at(a)) for a in "ij" for f in (F.min, F.max)]).first()  # one row
    return {"i": (r[0] or 0, r[1] or 0), "j": (r[2] or 0, r[3] or 0)}


#: Positions along a side of a block.
BLOCK = 64


def by_block(grid: DataFrame, sources: DataFrame, reach: int, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` on each block of positions and on the sources (_ni, _nj, n_*) at most ``reach`` from it.

    One shuffle: a source is copied to the blocks it is near, instead of each
    position to each place of its window, and no side is sent to the driver.
    """
    at = lambda a, d=0: F.floor((F.col(a) + d) / BLOCK)
    box = _box(grid, at)
    mine = grid.where("i IS NOT NULL AND j IS NOT NULL").withColumns({f"_b{a}": at(a) for a in "ij"})
    near = sources.select(*[F.col(c).alias(f"_n{c}" if c in ("i", "j") else f"n_{c}") for c in sources.columns])  # new attributes: a cogroup mixes up shared ones
    for a in "ij":
        near = near.withColumn(f"_b{a}", F.explode(F.sequence(at(f"_n{a}", -reach), at(f"_n{a}", reach)))).where(F.col(f"_b{a}").between(*box[a]))
    keys = ["_bi", "_bj"]
    return mine.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(lambda x, y: kernel(x.drop(columns=keys), y.drop(columns=keys)), schema)


def _near(some: pd.DataFrame, sources: pd.DataFrame, offsets: Sequence[tuple]) -> pd.DataFrame:
    """In a block, each of some rows with the sources at its offsets (_, di, dj)."""
    di, dj = (np.array([o[k] for o in offsets], dtype=np.int64) for k in (1, 2))
    x = some.loc[some.index.repeat(len(offsets))].reset_index(drop=True)
    x["di"], x["dj"] = np.tile(di, len(some)), np.tile(dj, len(some))
    x["_ni"], x["_nj"] = x["i"] + x["di"], x["j"] + x["dj"]
    return x.merge(sources, on=["_ni", "_nj"])


def sobel(grid: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Gradient magnitude by the Sobel weights, borders mirrored: each place adds its share to the positions around it."""
    v, di, dj = F.col("v"), F.col("o.di"), F.col("o.dj")
    shares = padded(grid, 1, ["v"], size).select("i", "j", "v", F.explode(_offsets(_square(1))).alias("o"))
    shares = shares.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), (v * di * (2 - F.abs(dj))).alias("gi"), (v * dj * (2 - F.abs(di))).alias("gj"), F.lit(0).alias("n"))
    own = grid.where("i IS NOT NULL AND j IS NOT NULL").select("i", "j", F.lit(None).cast("double").alias("gi"), F.lit(None).cast("double").alias("gj"), F.lit(1).alias("n"))
    sums = shares.union(own).groupBy("i", "j").agg(F.sum("gi").alias("gi"), F.sum("gj").alias("gj"), F.sum("n").alias("n"), F.count("*").alias("rows"))
    gi, gj = F.col("gi") * F.col("n"), F.col("gj") * F.col("n")
    return sums.where((F.col("n") > 0) & (F.col("rows") > F.col("n"))).select("i", "j", F.sqrt(gi * gi + gj * gj).alias("sobel"))


def median_filter(grid: DataFrame, radius: int, size: tuple[int, int], only: Column | None = None) -> DataFrame:
    """Median of the window around the positions that ``only`` selects; other positions keep their value."""
    offsets = ring_offsets("quad", radius)

    def medians(rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["i", "j", "v"], ignore_index=True)
        near = _near(rows[rows["on"]].assign(row=lambda x: x.index), sources, offsets)
        m = near.groupby("row")["n_v"].median()
        rows.loc[m.index, "v"] = m
        return rows[["i", "j", "v"]]

    on = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    return by_block(grid.select("i", "j", "v", on.alias("on")), padded(grid, radius, ["v"], size), radius, medians, "i long, j long, v double")


def weighted_median_filter(grid: DataFrame, radius: int, size: tuple[int, int], spatial: float = 18.0, colour: float = 0.1) -> DataFrame:
    """First value whose running bilateral weight reaches half of the window's; weights exp(-(d^2 / spatial^2 + dc^2 / colour^2)) of the guide ``c``."""
    offsets = ring_offsets("quad", radius)

    def medians(rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        near = _near(rows, sources, offsets)
        dc = near["n_c"] - near["c"]
        near["weight"] = np.exp(-((near["di"] ** 2 + near["dj"] ** 2) / (spatial * spatial) + dc * dc / (colour * colour)))
        near = near.dropna(subset="weight").sort_values(["i", "j", "n_v", "di", "dj"], ignore_index=True)
        run = near.groupby(["i", "j"])["weight"]
        near = near[run.cumsum() >= run.transform("sum") / 2]
        return near.drop_duplicates(["i", "j"])[["i", "j", "n_v"]].rename(columns={"n_v": "v"})

    return by_block(grid.select("i", "j", "c"), padded(grid, radius, ["v", "c"], size), radius, medians, "i long, j long, v double")


def cross_check(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """Pixels (i, j, v, occluded) of the left disparity whose right match is missing or differs by more than ``most``; v runs along i."""
    l = left.select("i", "j", "v", (F.col("i") - F.floor(F.col("v") + 0.5)).cast("long").alias("_ri"))
    r = right.select(F.col("i").alias("_ri"), F.col("j").alias("_rj"), F.col("v").alias("_rv"))
    both = l.join(r, (l["_ri"] == r["_ri"]) & (F.col("j") == F.col("_rj")), "left")
    return both.select("i", "j", "v", (F.col("_rv").isNull() | (F.abs(F.col("v") - F.col("_rv")) > most)).alias("occluded"))


def fill_occluded(grid: DataFrame, reach: int = 40) -> DataFrame:
    """Occluded pixels (i, j, v, occluded) get the least value of the nearest ring that has one; none in reach: their own."""

    def filled(rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows["occluded"]].assign(row=lambda x: x.index)
        for ring in range(1, reach + 1):
            if left.empty or sources.empty:
                break
            near = _near(left, sources, [o for o in ring_offsets("quad", ring) if o[0] == ring])
            fill = near.groupby("row")["n_v"].min()
            rows.loc[fill.index, "v"] = fill.where(fill.notna(), rows["v"].loc[fill.index])
            left = left.drop(index=fill.index)
        return rows[["i", "j", "v"]]

    out = by_block(grid.select("i", "j", "v", "occluded"), grid.where("NOT occluded").select("i", "j", "v"), reach, filled, "i long, j long, v double")
    return out.union(grid.where("i IS NULL OR j IS NULL").select("i", "j", "v"))


def edge_density(grid: DataFrame, threshold: float) -> DataFrame:
    """(i, j, active, density): values scaled to 0..1 by the global range, active at the threshold or above, 0..255."""
    box = grid.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    u = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return grid.join(F.broadcast(box)).select("i", "j", (u >= threshold).alias("active"), F.floor(u * 255 + 0.5).cast("long").alias("density"))


def bilinear(grid: DataFrame, points: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Value of the grid at fractional positions (id, x along i, y along j), clamped to its borders."""
    x = F.greatest(F.lit(0.0), F.least(F.col("x"), F.lit(float(size[0] - 1))))
    y = F.greatest(F.lit(0.0), F.least(F.col("y"), F.lit(float(size[1] - 1))))
    p = points.select("id", x.alias("x"), y.alias("y"))
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    corner = lambda di, dj: F.struct(F.least(F.floor("x") + di, F.lit(size[0] - 1)).alias("i"), F.least(F.floor("y") + dj, F.lit(size[1] - 1)).alias("j"), ((fx if di else 1 - fx) * (fy if dj else 1 - fy)).alias("w"))
    x = p.select("id", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("o")).select("id", "o.i", "o.j", "o.w")
    return x.join(grid.select("i", "j", "v"), ["i", "j"]).groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


# --- Objective terms of nets: (i, j, x, y) ---------------------------------------------------------


def length_term(net: DataFrame) -> DataFrame:
    """Per node, the distance to its right and lower neighbours."""
    near = shifted(net, [(1, 0, 1), (0, 1, 1)], ["x", "y"])
    dx, dy = F.col("n_x") - F.col("x"), F.col("n_y") - F.col("y")
    near = near.groupBy("i", "j").agg(F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"))
    return net.select("i", "j").join(near, ["i", "j"], "left").select("i", "j", F.coalesce("length", F.lit(0.0)).alias("length"))


def smooth_term(net: DataFrame) -> DataFrame:
    """Per node, the summed distance of its motion (u, v) to those of its 4 neighbours."""
    near = shifted(net, [(1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)], ["u", "v"])
    du, dv = F.col("n_u") - F.col("u"), F.col("n_v") - F.col("v")
    return near.groupBy("i", "j").agg(F.sum(F.sqrt(du * du + dv * dv)).alias("smooth"))


def data_term(net: DataFrame, target: DataFrame, size: tuple[int, int], colour: float = 0.5, gradient: float = 0.5, most_colour: float = 30.0, most_gradient: float = 10.0) -> DataFrame:
    """Per node (i, j, v, g, u), truncated colour and gradient difference to the target (i, j, v, g) at i + u."""
    t = target.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("v").alias("_v"), F.col("g").alias("_g"))
    at = F.greatest(F.lit(0), F.least(F.floor(F.col("i") + F.col("u") + 0.5), F.lit(size[0] - 1)))
    both = net.join(t, (at == F.col("_i")) & (F.col("j") == F.col("_j")))
    cost = F.least(F.abs(F.col("v") - F.col("_v")), F.lit(most_colour)) * colour + F.least(F.abs(F.col("g") - F.col("_g")), F.lit(most_gradient)) * gradient
    return both.select("i", "j", cost.alias("cost"))


def window_term(costs: DataFrame, radius: int, size: tuple[int, int]) -> DataFrame:
    """Costs summed over the window around each position, borders mirrored."""
    return shifted(costs, _square(radius), ["cost"], size).groupBy("i", "j").agg(F.sum("n_cost").alias("cost"))


def objective(terms: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: sum of each term and their weighted total."""
    sums = [F.sum(k).alias(k) for k in weights]
    total = None
    for k, w in weights.items():
        total = F.col(k) * w if total is None else total + F.col(k) * w
    return terms.agg(*sums).select("*", total.alias("objective"))


def cell_objective(terms: DataFrame, side: int, weights: dict[str, float]) -> DataFrame:
    """The weighted total of each square of ``side`` positions."""
    total = None
    for k, w in weights.items():
        total = F.col(k) * w if total is None else total + F.col(k) * w
    return terms.groupBy(F.floor(F.col("i") / side).alias("ci"), F.floor(F.col("j") / side).alias("cj")).agg(F.sum(total).alias("objective"))


def contours(labels: DataFrame, least: int = 2) -> DataFrame:
    """Pixels with at least so many of 8 neighbours under another label."""
    near = shifted(labels, _square(1, False), ["label"]).groupBy("i", "j", "label").agg(F.count_if(F.col("n_label") != F.col("label")).alias("n"))
    return near.where(F.col("n") >= least).select("i", "j")


#: Priors of a motion's smoothness: truncated quadratic, truncated linear, constant but for jumps, linear.
PRIORS = ("pstq", "pstl", "pcp", "esl")


def prior_term(net: DataFrame, prior: str, most: float = 10.0) -> DataFrame:
    """Per node, the prior's energy between its motion (u, v) and those of its right and lower neighbours."""
    near = shifted(net, [(1, 0, 1), (0, 1, 1)], ["u", "v"])
    du, dv = F.col("n_u") - F.col("u"), F.col("n_v") - F.col("v")
    d = F.sqrt(du * du + dv * dv)
    energy = {"pstq": F.least(d * d, F.lit(most * most)), "pstl": F.least(d, F.lit(most)), "pcp": ((du != 0) | (dv != 0)).cast("double"), "esl": d}[prior]
    sums = near.groupBy("i", "j").agg(F.sum(energy).alias("smooth"))
    return net.select("i", "j").join(sums, ["i", "j"], "left").select("i", "j", F.coalesce("smooth", F.lit(0.0)).alias("smooth"))


def length_difference(net: DataFrame, target: DataFrame) -> DataFrame:
    """Per node, how far its length term is from that of the target net."""
    other = length_term(target).withColumnRenamed("length", "_length")
    return length_term(net).join(other, ["i", "j"]).select("i", "j", F.abs(F.col("length") - F.col("_length")).alias("smooth"))


def motion_error(net: DataFrame, truth: DataFrame) -> DataFrame:
    """Per node, the distance of its motion (u, v) to the true one."""
    both = net.select("i", "j", "u", "v").join(truth.select("i", "j", F.col("u").alias("_u"), F.col("v").alias("_v")), ["i", "j"])
    du, dv = F.col("u") - F.col("_u"), F.col("v") - F.col("_v")
    return both.select("i", "j", F.sqrt(du * du + dv * dv).alias("error"))


def squared_window_term(costs: DataFrame, radius: int, size: tuple[int, int]) -> DataFrame:
    """Squared costs summed over the window around each position, borders mirrored."""
    return window_term(costs.select("i", "j", (F.col("cost") * F.col("cost")).alias("cost")), radius, size)
