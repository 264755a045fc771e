"""Exact Euclidean minimum spanning forests and trees.

Points of equal coordinates are joined by edges of length 0 first. The forest of
all edges up to a radius is the part of the tree that is that short, so the
radius grows from one that crowds no cell: the first forest comes from the
pairs of neighbouring cells, later ones from the closest pairs of components,
found by pruning pairs of cells with bounds from their boxes. A pair inside a
component is never looked at again. Edges are ordered by (squared length, least
id, greatest id), so the tree is unique.

A forest of edges is found as sums are: the forest of a part of the edges holds
all of the whole's forest in that part, so tasks first cut blocks of neighbouring
cells to their forests.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from grovespark.operators.components import CHUNK, LOCAL_EDGES, connected_components, spanning_forest
from grovespark.operators.neighbors import pairs_within, start_radius, valid
from grovespark.runtime import stored, width

#: Points around each at the first radius; growth of the radius; cells of a block.
AROUND, GROWTH, BLOCK = 8, 4, 16
_EDGES = ["a", "b", "src", "dst", "d2"]
_KINDS = dict(zip(_EDGES, (np.int64, np.int64, np.int64, np.int64, np.float64)))


def minimum_forest(e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning forest of edges (a, b, src, dst, d2) between nodes a and b: places of its edges, nodes, and a node of each one's tree."""
    order = np.lexsort((e["dst"], e["src"], e["d2"]))
    keep, nodes, roots = spanning_forest(e["a"][order], e["b"][order])
    return order[keep], nodes, roots


def _arrays(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([np.zeros(0, t), *[b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for b in batches]]).astype(t) for k, t in _KINDS.items()}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task cut to their forest, CHUNK at a time and then together."""
    held: dict[str, np.ndarray] = _arrays([])
    new: list[pa.RecordBatch] = []

    def merged() -> dict[str, np.ndarray]:
        more = _arrays(new)
        both = {k: np.concatenate([held[k], more[k]]) for k in _EDGES}
        keep = minimum_forest(both)[0]
        return {k: v[keep] for k, v in both.items()}

    many = 0
    for b in batches:
        new.append(b)
        many += b.num_rows
        if many >= CHUNK:
            held, new, many = merged(), [], 0
    held = merged()
    yield pa.RecordBatch.from_arrays([pa.array(held[k]) for k in _EDGES], _EDGES)


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges (src, dst, d2), and rows (src: a node, dst: its tree) without a length."""
    e = _arrays(list(batches))
    keep, nodes, roots = minimum_forest(e)
    yield pa.RecordBatch.from_arrays([pa.array(e["src"][keep]), pa.array(e["dst"][keep]), pa.array(e["d2"][keep])], ["src", "dst", "d2"])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.nulls(len(nodes), pa.float64())], ["src", "dst", "d2"])


def forest_rounds(edges: DataFrame, nodes: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """``rounds`` rounds of Boruvka: in each, every component takes its least edge to another one.

    edges (src, dst, d2), nodes (node); returns the forest's edges with the round
    that took each, and (node, component). Run on a spanning tree, it gives the
    same forests as on all pairs, since a component's least edge is in the tree.
    """
    comp = nodes.select("node", F.col("node").alias("component"))
    out = None
    for k in range(1, rounds + 1):
        ends = edges.join(comp.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(comp.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").where("a <> b")
        least = F.min(F.struct("d2", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "src", "dst", "a", "b")).alias("e")
        taken = stored(ends.select("*", F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(least).select("e.src", "e.dst", "e.d2", "e.a", "e.b").distinct(), "taken")
        if taken.isEmpty():
            break
        joined = connected_components(taken, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("joined"))
        comp = stored(comp.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "components")
        now = taken.select("src", "dst", "d2", F.lit(k).alias("round"))
        out = now if out is None else out.union(now)
    if out is None:
        out = edges.limit(0).select("src", "dst", "d2", F.lit(0).alias("round"))
    return out, comp


def _forest(edges: DataFrame, block: Sequence[Column] = (), local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame, int]:
    """Minimum spanning forest of edges (a, b, src, dst, d2) between components a and b.

    Returns its edges (src, dst, d2), (node, component) of the nodes of the
    edges, and the number of its edges. ``block`` names the block of an edge.
    """
    schema = "a long, b long, src long, dst long, d2 double"
    if block:
        edges = edges.repartition(width(edges.sparkSession), *block).select(*_EDGES).mapInArrow(_cut, schema)
    edges = stored(edges.select(*_EDGES), "pairs")
    done = chain = None
    while edges.count() > local_edges:  # contract: every component takes its least edge
        both = edges.select("*", F.explode(F.array("a", "b")).alias("c"))
        taken = stored(both.groupBy("c").agg(F.min(F.struct("d2", "src", "dst", "a", "b")).alias("e")).select("e.a", "e.b", "e.src", "e.dst", "e.d2").distinct(), "taken")
        done = taken.select("src", "dst", "d2") if done is None else done.union(taken.select("src", "dst", "d2"))
        comp = stored(connected_components(taken, "a", "b"), "joined")
        chain = comp if chain is None else stored(_then(chain, comp), "joined")
        for end in "ab":
            edges = edges.join(comp.select(F.col("node").alias(end), F.col("component").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
        lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        edges = edges.where("a <> b").groupBy(lo, hi).agg(F.min(F.struct("d2", "src", "dst")).alias("e")).select("a", "b", "e.src", "e.dst", "e.d2")
        edges = stored(edges, "pairs")
    last = stored(edges.repartition(1).mapInArrow(_last, "src long, dst long, d2 double"), "forest")
    own, comp = last.where("d2 IS NOT NULL"), last.where("d2 IS NULL").select(F.col("src").alias("node"), F.col("dst").alias("component"))
    own, comp = (own, comp) if done is None else (done.union(own), _then(chain, comp))
    return own, comp, own.count()


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """(node, component) after two steps of joining components, the second over those of the first."""
    moved = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
    return moved.union(second.join(first.select("node"), "node", "left_anti").select("node", "component"))


def _corner(axes: Sequence[str]) -> list[Column]:
    return [f(F.col(f"{n}_{a}")).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]


def _gap(axes: Sequence[str], far: bool) -> Column:
    """Least squared distance of two boxes, or the greatest."""
    total = F.lit(0.0)
    for a in axes:
        if far:
            d = F.greatest(F.col(f"r_hi_{a}") - F.col(f"l_lo_{a}"), F.col(f"l_hi_{a}") - F.col(f"r_lo_{a}"))
        else:
            d = F.greatest(F.col(f"r_lo_{a}") - F.col(f"l_hi_{a}"), F.col(f"l_lo_{a}") - F.col(f"r_hi_{a}"), F.lit(0.0))
        total = total + d * d
    return total


def _closest(boxes: DataFrame, points: DataFrame, axes: Sequence[str], level: int, side: float) -> DataFrame:
    """The least edge (a, b, src, dst, d2) of each pair of components, among those at most the level's radius long."""
    cells = [f"c{a}" for a in axes]
    box = [f"{n}_{a}" for a in axes for n in ("lo", "hi")]
    radius = side * GROWTH**level

    def at(k: int) -> DataFrame:
        step = GROWTH**k
        own = boxes.select("component", *[F.floor(F.col(c) / step).cast("long").alias(c) for c in cells], *box)
        return own.groupBy("component", *cells).agg(*_corner(axes))

    def named(df: DataFrame, s: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns])

    def pruned(pairs: DataFrame) -> DataFrame:
        x = pairs.withColumn("near", _gap(axes, False)).withColumn("far", _gap(axes, True)).where(F.col("near") <= radius * radius * (1 + 1e-9))
        x = x.withColumn("_far", F.min("far").over(Window.partitionBy("l_component", "r_component")))
        return x.where(F.col("near") <= F.col("_far") * (1 + 1e-9)).drop("_far", "near", "far")

    around = F.array(*[F.struct(*[F.lit(o).alias(c) for o, c in zip(off, cells)]) for off in product((-1, 0, 1), repeat=len(axes))])
    left = named(at(level), "l").withColumn("_o", F.explode(around))
    on = [(F.col(f"l_{c}") + F.col(f"_o.{c}")) == F.col(f"r_{c}") for c in cells]
    pairs = pruned(left.join(named(at(level), "r"), on).where("l_component < r_component").drop("_o"))
    for k in range(level - 1, -1, -1):
        own = at(k) if k else boxes.select("component", *cells, *box)
        for s in "lr":
            child = named(own, "n").withColumns({f"_p{c}": F.floor(F.col(f"n_{c}") / GROWTH).cast("long") for c in cells})
            same = [F.col(f"{s}_component") == F.col("n_component"), *[F.col(f"{s}_{c}") == F.col(f"_p{c}") for c in cells]]
            kept = [c for c in pairs.columns if not c.startswith(f"{s}_")]
            pairs = pairs.join(child, same).select(*kept, *[F.col(f"n_{c}").alias(f"{s}_{c}") for c in ["component", *cells, *box]])
        pairs = pruned(pairs)
        if k % 2 == 0:
            pairs = stored(pairs, "boxes")
    ends = points.select("id", "component", *axes, *[F.floor(F.col(a) / side).cast("long").alias(f"c{a}") for a in axes])
    for s in "lr":
        p = named(ends, f"{s}p")
        same = [F.col(f"{s}_component") == F.col(f"{s}p_component"), *[F.col(f"{s}_{c}") == F.col(f"{s}p_{c}") for c in cells]]
        pairs = pairs.join(p, same)
    d2 = F.lit(0.0)
    for a in axes:
        d = F.col(f"lp_{a}") - F.col(f"rp_{a}")
        d2 = d * d if a == axes[0] else d2 + d * d
    ids = F.least("lp_id", "rp_id").alias("src"), F.greatest("lp_id", "rp_id").alias("dst")
    best = pairs.select(F.col("l_component").alias("a"), F.col("r_component").alias("b"), *ids, d2.alias("d2")).where(F.col("d2") <= radius * radius)
    return best.groupBy("a", "b").agg(F.min(F.struct("d2", "src", "dst")).alias("e")).select("a", "b", "e.src", "e.dst", "e.d2")


def emst(points: DataFrame, axes: Sequence[str] = ("x", "y"), local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Edges (src < dst, length) of the minimum spanning tree of points (id, axes).

    n points give n - 1 edges; none for 0 or 1 point. Rows with a null, NaN or
    infinite coordinate are left out. A point equal to others hangs on that of the
    smallest id with length 0. Live edges beyond ``local_edges`` are contracted
    in rounds over all tasks.
    """
    own = valid(points.select(F.col("id").cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in axes]), axes)
    own = stored(own.withColumn("_rep", F.min("id").over(Window.partitionBy(*axes))), "points")
    reps, same = own.where("id = _rep").drop("_rep"), own.where("id <> _rep").select(F.col("_rep").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d2"))
    side, across, n = start_radius(reps, axes, AROUND)
    near = pairs_within(reps, reps, axes, side).where("src < dst")
    block = [F.floor(F.col(f"s_{a}") / (side * BLOCK)) for a in axes]
    tree, joined, many = _forest(near.select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst", "d2", *[v.alias(f"_b{k}") for k, v in enumerate(block)]), [F.col(f"_b{k}") for k in range(len(axes))], local_edges)
    comp = reps.join(joined.select(F.col("node").alias("id"), F.col("component").alias("_c")), "id", "left").select(F.coalesce("_c", "id").alias("component"), "id", *axes)
    level, left = 0, n - many
    while left > 1 and side * GROWTH**level <= across:
        level += 1
        comp = stored(comp, "components")
        cells = [F.floor(F.col(a) / side).cast("long").alias(f"c{a}") for a in axes]
        boxes = stored(comp.groupBy("component", *cells).agg(*[f(a).alias(f"{m}_{a}") for a in axes for m, f in (("lo", F.min), ("hi", F.max))]), "boxes")
        new, joined, many = _forest(_closest(boxes, comp, axes, level, side), local_edges=local_edges)
        tree, left = tree.union(new), left - many
        comp = comp.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left").withColumn("component", F.coalesce("_c", "component")).drop("_c")
    return tree.union(same).select("src", "dst", F.sqrt("d2").alias("length"))


def emst_summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("size"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"))


def node_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """degree and length of the edges of every node."""
    both = edges.select(F.explode(F.array("src", "dst")).alias("id"), "length").groupBy("id").agg(F.count("*").alias("degree"), F.sum("length").alias("length"))
    return nodes.select("id").join(both, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("length", F.lit(0.0)).alias("length"))


def single_linkage(edges: DataFrame, nodes: DataFrame, cut: float) -> DataFrame:
    """Clusters (id, cluster) that remain of a spanning tree without edges longer than ``cut``."""
    comp = connected_components(edges.where(F.col("length") <= cut), "src", "dst")
    return nodes.select("id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def filter_edges(edges: DataFrame, attributes: DataFrame, most: float) -> DataFrame:
    """Edges whose ends' attribute values (id, v) are at most ``most`` apart."""
    a, b = (attributes.select(F.col("id").alias(e), F.col("v").alias(f"v_{e}")) for e in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").where(F.abs(F.col("v_src") - F.col("v_dst")) <= most).select("src", "dst", "length")


def boundary_nodes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes with an edge to a node of another label (id, label)."""
    a, b = (labels.select(F.col("id").alias(e), F.col("label").alias(f"l_{e}")) for e in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").where("l_src <> l_dst").select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def find_min_pair(pairs: DataFrame) -> DataFrame:
    """Least edge (d2, src, dst) out of each component a of pairs (a, b, src, dst, d2)."""
    order = F.struct("d2", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    return pairs.where("a <> b").groupBy(F.col("a").alias("component")).agg(F.min(order).alias("e")).select("component", "e.d2", "e.lo", "e.hi")


def closed_tour_length(tour: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Length of each closed tour (tour, place, axes)."""
    w = Window.partitionBy("tour").orderBy("place")
    whole = Window.partitionBy("tour").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d2 = None
    for a in axes:
        d = F.coalesce(F.lead(a).over(w), F.first(a).over(whole)) - F.col(a)
        d2 = d * d if d2 is None else d2 + d * d
    return tour.select("tour", F.sqrt(d2).alias("_d")).groupBy("tour").agg(F.sum("_d").alias("length"))
