"""Connected components of an edge list: spanning forests of parts of it, then one task or rounds of hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grovespark.runtime import stored

#: Edges that a task cuts to a forest at once; edges up to which one task gets all that are left, counted first (some 100 MB).
CHUNK, LOCAL_EDGES = 500_000, 4_000_000


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forest that takes edges (a, b) in their order where they join two trees: places of its edges, nodes, and a node of each one's tree.

    Rounds in which every tree takes its first edge to another one and trees are
    joined by pointer jumping, over whole arrays.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = ends[: len(a)], ends[len(a) :]
    every = np.arange(len(nodes))
    root, keep, live = every, np.zeros(len(a), bool), np.arange(len(a))
    while True:
        ca, cb = root[ia[live]], root[ib[live]]
        across = ca != cb
        live, ca, cb = live[across], ca[across], cb[across]
        if not len(live):
            return np.flatnonzero(keep), nodes, nodes[root]
        first = np.full(len(nodes), len(a))
        for c in (ca, cb):  # live edges ascend: written backwards, the first one stays
            own = np.full(len(nodes), len(a))
            own[c[::-1]] = live[::-1]
            np.minimum(first, own, out=first)
        trees = np.flatnonzero(first < len(a))
        pick = first[trees]
        keep[pick] = True
        parent = every.copy()
        parent[trees] = np.where(root[ia[pick]] == trees, root[ib[pick]], root[ia[pick]])
        mutual = (parent[parent] == every) & (every < parent)
        parent[mutual] = every[mutual]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        root = parent[root]


def _ends(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, np.int64), *[b.column(k).to_numpy(zero_copy_only=False) for b in batches]]) for k in (0, 1)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges cut to a forest with the same components; a node by itself is an edge to itself."""
    held: list[pa.RecordBatch] = []
    many = 0

    def cut() -> list[pa.RecordBatch]:
        a, b = _ends(held)
        keep, nodes, _ = spanning_forest(a, b)
        alone = np.setdiff1d(nodes, np.concatenate([a[keep], b[keep]]))
        return [pa.RecordBatch.from_arrays([pa.array(np.concatenate([v[keep], alone])) for v in (a, b)], ["a", "b"])]

    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= CHUNK:
            held, many = cut(), 0
    if held:
        yield cut()[0]


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, nodes, roots = spanning_forest(*_ends(list(batches)))
    _, tree = np.unique(roots, return_inverse=True)
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, tree, nodes)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least[tree])], ["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """One row ``(node, component)`` for each node of ``edges``, whole numbers; component is the smallest node it reaches.

    Edges with a null end are ignored; self-loops keep their node. Every task
    first cuts its edges to a forest. Up to ``local_edges`` edges, as counted
    then, one task ends the work. More go through rounds of two linear steps until
    nothing changes: every star hangs its larger neighbours under its minimum
    (large star), then every node hangs its smaller neighbours under their minimum
    (small star). The number of rounds is logarithmic in practice, no
    neighbourhood is gathered into memory, and the round's result is a table in
    the shared folder.
    """
    e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    e = stored(e.mapInArrow(_cut, "a long, b long"), "edges")
    if e.count() <= local_edges:
        return e.repartition(1).mapInArrow(_labels, "node long, component long")
    nodes = stored(e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct(), "nodes")
    e = stored(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(low, "a")
        e = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        e = stored(e, "stars")
        # A star forest no longer changes; two sums that depend on every edge tell.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
