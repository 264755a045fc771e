"""Batch k-means, self-organising maps, superpixels and roulette sampling."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, log

from pyspark.sql import Column, DataFrame, Window, functions as F

from grovespark.functions.geometry import bell, squared
from grovespark.operators.components import connected_components
from grovespark.operators.neighbors import nearest
from grovespark.operators.windows import _offsets, ring_offsets
from grovespark.runtime import stored


def assign(points: DataFrame, centres: DataFrame, axes: Sequence[str], most_broadcast: int = 10_000) -> DataFrame:
    """(id, centre, d2): the nearest centre of each point, ties by the smaller id.

    Up to ``most_broadcast`` centres, counted first, go to all tasks as one array;
    more are found through cells.
    """
    n = centres.count()
    if n > most_broadcast:
        q = points.select(F.col("id"), *axes)
        apart = centres.select((-F.col("id") - 1).alias("id"), *axes)  # ids of the two sides must differ
        return nearest(q, apart, axes).select(F.col("src").alias("id"), (-F.col("dst") - 1).alias("centre"), "d2")
    all_centres = centres.agg(F.collect_list(F.struct("id", *axes)).alias("cs"))
    each = F.transform("cs", lambda c: F.struct(squared(list(axes), [c[a] for a in axes]).alias("d2"), c["id"].alias("centre")))
    return points.join(F.broadcast(all_centres)).select("id", F.array_min(each).alias("b")).select("id", "b.centre", "b.d2")


def kmeans_step(points: DataFrame, centres: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Centres (id, axes, n) moved to the mean of the points nearest to them; one without points stays."""
    own = assign(points, centres, axes)
    means = points.join(own, "id").groupBy("centre").agg(*[F.avg(a).alias(f"m_{a}") for a in axes], F.count("*").alias("n"))
    return centres.join(means.withColumnRenamed("centre", "id"), "id", "left").select("id", *[F.coalesce(f"m_{a}", a).alias(a) for a in axes], F.coalesce("n", F.lit(0)).alias("n"))


def kmeans(points: DataFrame, centres: DataFrame, axes: Sequence[str], rounds: int) -> DataFrame:
    for _ in range(rounds):
        centres = stored(kmeans_step(points, centres, axes).select("id", *axes), "centres")
    return centres


def kmeans_cost(points: DataFrame, centres: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Sum and mean of squared distances to the nearest centre."""
    return assign(points, centres, axes).agg(F.sum("d2").alias("cost"), F.avg("d2").alias("mean_cost"))


def schedule(first: float, last: float, rounds: int) -> list[float]:
    """Geometric decay from ``first`` to ``last``."""
    k = exp(log(last / first) / rounds) if rounds else 1.0
    return [first * k**t for t in range(rounds)]


def som_trigger(net: DataFrame, attractors: DataFrame, alpha: float, radius: float, topology: str = "quad") -> DataFrame:
    """One step of a net (i, j, x, y, fixed): each attractor (i, j, px, py) pulls the nodes around it by alpha * exp(-ring^2 / radius^2).

    Pulls on a node add up from its place before the step, so the order of
    attractors doesn't matter; fixed nodes stay.
    """
    reach = max(1, int(2 * radius))
    rings = [(i, j, r) for r, i, j in ring_offsets(topology, reach)]
    pull = attractors.select("i", "j", "px", "py", F.explode(_offsets(rings)).alias("o"))
    pull = pull.select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), "px", "py", (bell("o.w", F.lit(radius)) * alpha).alias("k"))
    sums = pull.groupBy("i", "j").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("px")).alias("kx"), F.sum(F.col("k") * F.col("py")).alias("ky"))
    move = lambda v: F.when(F.col("fixed") | F.col("k").isNull(), F.col(v)).otherwise(F.col(v) + F.col(f"k{v}") - F.col("k") * F.col(v)).alias(v)
    return net.join(sums, ["i", "j"], "left").select("i", "j", move("x"), move("y"), "fixed")


def ring_trigger(net: DataFrame, n: int, attractors: DataFrame, alpha: float, radius: float) -> DataFrame:
    """The same on a closed chain (i, x, y) of n nodes."""
    reach = max(1, int(2 * radius))
    offs = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(abs(d))).alias("w")) for d in range(-reach, reach + 1)])
    pull = attractors.select(F.explode(offs).alias("o"), "i", "px", "py").select(F.pmod(F.col("i") + F.col("o.d"), F.lit(n)).alias("i"), "px", "py", (bell("o.w", F.lit(radius)) * alpha).alias("k"))
    sums = pull.groupBy("i").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("px")).alias("kx"), F.sum(F.col("k") * F.col("py")).alias("ky"))
    move = lambda v: F.when(F.col("k").isNull(), F.col(v)).otherwise(F.col(v) + F.col(f"k{v}") - F.col("k") * F.col(v)).alias(v)
    return net.join(sums, "i", "left").select("i", move("x"), move("y"))


def injected(members: DataFrame, winners: DataFrame, values: Sequence[str]) -> DataFrame:
    """Members (id, centre) with the values of their winner (id, values): Voronoi colouring, label sets, write-back."""
    return members.join(winners.select(F.col("id").alias("centre"), *values), "centre").select("id", "centre", *values)


def label_regions(labels: DataFrame, most: int) -> DataFrame:
    """Make labels (i, j, label) connected: 4-connected regions of at most ``most`` pixels take the smallest label beside them.

    Returns (i, j, region, label); region is a pixel number of the region.
    """
    own = labels.select("i", "j", "label", F.xxhash64("i", "j").alias("_h"), (F.col("i").cast("long") * (1 << 31) + F.col("j")).alias("id"))
    beside = own.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("label").alias("_label"), F.col("id").alias("_id"))
    near = own.select("*", F.explode(_offsets([(1, 0, 1), (0, 1, 1)])).alias("o"))
    near = stored(near.join(beside, (F.col("i") + F.col("o.di") == F.col("_i")) & (F.col("j") + F.col("o.dj") == F.col("_j"))).select("id", "label", "_id", "_label"), "beside")
    comp = connected_components(near.where("label = _label"), "id", "_id").select(F.col("node").alias("id"), "component")
    own = stored(own.join(comp, "id", "left").select("i", "j", "label", "id", F.coalesce("component", "id").alias("region")), "regions")
    sizes = own.groupBy("region").agg(F.count("*").alias("n"))
    region = own.select("id", "region")
    across = near.where("label <> _label")
    both = across.select("id", F.col("_label").alias("other")).union(across.select(F.col("_id").alias("id"), F.col("label").alias("other")))
    next_to = both.join(region, "id").groupBy("region").agg(F.min("other").alias("other"))
    small = sizes.where(F.col("n") <= most).join(next_to, "region").select("region", "other")
    return own.join(small, "region", "left").select("i", "j", "region", F.coalesce("other", "label").alias("label"))


def roulette(items: DataFrame, group: str, weight: Column, u: Column) -> DataFrame:
    """One item (id) per group: the first in order of id whose running weight reaches u times the total."""
    run = Window.partitionBy(group).orderBy("id")
    x = items.withColumn("_w", weight).withColumns({"_run": F.sum("_w").over(run), "_total": F.sum("_w").over(Window.partitionBy(group)), "_u": u})
    return x.where(F.col("_run") >= F.col("_u") * F.col("_total")).groupBy(group).agg(F.min("id").alias("id"))


def weighted_sample(items: DataFrame, group: str, weight: Column, k: int, seed: int, u: Column | None = None) -> DataFrame:
    """k items per group without replacement, by weight: the greatest keys log(u) / w, with ``u`` or else a uniform number from a hash of id and seed."""
    if u is None:
        u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
    rank = Window.partitionBy(group).orderBy(F.desc("_key"), "id")
    return items.withColumn("_key", F.log(u) / weight).withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= k).drop("_key", "_k")


def lattice(spark, width: int, height: int, step: float) -> DataFrame:
    """Regular net (i, j, x, y), all free."""
    return spark.range(width * height).select((F.col("id") % width).alias("i"), F.floor(F.col("id") / width).alias("j")).select("i", "j", (F.col("i") * step).alias("x"), (F.col("j") * step).alias("y"), F.lit(False).alias("fixed"))


def density_cost(members: DataFrame) -> DataFrame:
    """Sum over clusters of the distance of their size to the mean size (id, centre)."""
    sizes = members.groupBy("centre").agg(F.count("*").alias("n"))
    return sizes.agg(F.avg("n").alias("m"), F.collect_list("n").alias("ns")).select(F.aggregate("ns", F.lit(0.0), lambda a, n: a + F.abs(n - F.col("m"))).alias("cost"))


#: Steps to the 8 neighbours, in the order in which a seed tries them.
STEPS = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def perturbed_seeds(seeds: DataFrame, gradient: DataFrame) -> DataFrame:
    """Seeds (id, i, j) that step to each of the 8 neighbours in turn if the gradient (i, j, v) is lower there than where they are by then."""
    at = gradient.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    now = seeds.join(gradient.select("i", "j", "v"), ["i", "j"]).select("id", "i", "j", "v")
    for di, dj in STEPS:
        near = now.join(at, (F.col("i") + di == F.col("_i")) & (F.col("j") + dj == F.col("_j")), "left")
        go = F.coalesce(F.col("_v") < F.col("v"), F.lit(False))
        now = near.select("id", *[F.when(go, F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in ("i", "j", "v")])
    return now


def fixed_borders(cells: DataFrame, size: tuple[int, int], radius: int, centre: tuple[int, int], topology: str = "quad") -> DataFrame:
    """Positions of a base lattice on the rings ``radius - 1`` and ``radius`` around the centres of cells (i, j) two steps apart."""
    rings = [(i, j, r) for r, i, j in ring_offsets(topology, radius) if r >= radius - 1]
    x = cells.select(*[(F.col(k) * 2 + c % 2).alias(k) for k, c in zip("ij", centre)], F.explode(_offsets(rings)).alias("o"))
    x = x.select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"))
    return x.where(F.col("i").between(0, size[0] - 1) & F.col("j").between(0, size[1] - 1)).distinct()


def shared_out(nodes: DataFrame, total: int, cells: int) -> DataFrame:
    """Nodes (id from 0) dealt to cells in even slices."""
    slab = -(-total // cells)
    return nodes.withColumn("cell", F.floor(F.col("id") / slab)).withColumn("place", F.col("id") % slab)


def hops(links: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, node, hop): nodes at most ``most`` links (src, dst, either way) away from each source (node), by the fewest links."""
    both = links.select("src", "dst").union(links.select("dst", "src")).distinct()
    seen = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hop"))
    edge = seen
    for k in range(1, most + 1):
        step = edge.join(both, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        edge = stored(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hop", F.lit(k)), "hops")
        seen = seen.union(edge)
    return seen


def graph_trigger(net: DataFrame, links: DataFrame, attractors: DataFrame, alpha: float, radius: float, most: int) -> DataFrame:
    """One step of a net (id, x, y): each attractor (node, px, py) pulls the nodes up to ``most`` links away by alpha * exp(-hop^2 / radius^2); pulls add up."""
    near = hops(links, attractors.select("node").distinct(), most)
    pull = attractors.withColumnRenamed("node", "source").join(near, "source").select(F.col("node").alias("id"), "px", "py", (bell("hop", F.lit(radius)) * alpha).alias("k"))
    sums = pull.groupBy("id").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("px")).alias("kx"), F.sum(F.col("k") * F.col("py")).alias("ky"))
    move = lambda v: F.when(F.col("k").isNull(), F.col(v)).otherwise(F.col(v) + F.col(f"k{v}") - F.col("k") * F.col(v)).alias(v)
    return net.join(sums, "id", "left").select("id", move("x"), move("y"))


def path_nodes(links: DataFrame, start: int, end: int, most: int) -> DataFrame:
    """Nodes (node) on the shortest paths of links between two nodes at most ``most`` links apart: those to be fixed."""
    spark = links.sparkSession
    one, two = (hops(links, spark.createDataFrame([(v,)], "node long"), most).select("node", F.col("hop").alias(f"h{k}")) for k, v in enumerate((start, end)))
    both = one.join(two, "node").withColumn("through", F.col("h0") + F.col("h1"))
    least = both.agg(F.min("through").alias("least"))
    return both.join(F.broadcast(least)).where("through = least").select("node")


def step_statistics(steps: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean and deviation of a measured value for each step of a run."""
    return steps.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("deviation"))
