"""Local search and population search: one row per node or agent, one query per round."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from grovespark.runtime import stored


def winner_takes_all(candidates: DataFrame, by: Sequence[str], cost: str = "cost") -> DataFrame:
    """The cheapest candidate of each node, ties by the smaller value (by.., v, cost)."""
    best = candidates.groupBy(*by).agg(F.min(F.struct(cost, "v")).alias("b"))
    return best.select(*by, "b.v", F.col(f"b.{cost}").alias(cost))


def stereo_candidates(pixels: DataFrame, most: int) -> DataFrame:
    """Each pixel with every disparity 0..most that stays in the image."""
    return pixels.select("i", "j", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.col("i").cast("int")))).alias("v"))


def propagated_candidates(field: DataFrame) -> DataFrame:
    """Each pixel with its own value and those of its 4 neighbours."""
    offs = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    out = field.select(F.explode(offs).alias("o"), "i", "j", "v").select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), "v")
    return out.join(field.select("i", "j"), ["i", "j"], "left_semi").distinct()


def random_candidates(field: DataFrame, reach: float, seed: int) -> DataFrame:
    """Each pixel with a value at most ``reach`` from its own, from a hash of place and seed."""
    u = F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return field.select("i", "j", (F.col("v") + (u * 2 - 1) * reach).alias("v"))


def local_search(field: DataFrame, propose: Callable[[DataFrame, int], DataFrame], cost: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """Rounds of proposals to alternate colours of the checkerboard; each node keeps the cheapest of its own value and its proposals.

    field (i, j, v); ``cost`` adds a column cost to (i, j, v) rows, given as the
    whole of candidates. A node's neighbours hold still while it moves, so the
    total never rises.
    """
    for k in range(rounds):
        mine = (F.col("i") + F.col("j")) % 2 == k % 2
        options = field.where(mine).select("i", "j", "v").union(propose(field, k).where(mine).select("i", "j", "v")).distinct()
        best = winner_takes_all(cost(options), ["i", "j"]).select("i", "j", "v")
        field = stored(best.union(field.where(~mine).select("i", "j", "v")), "field")
    return field


def line_candidates(field: DataFrame, direction: tuple[int, int], reach: int, scale: float = 1.0) -> DataFrame:
    """Each node (i, j, x, y) with its place and those 1..reach steps along one direction (step, x, y)."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("step")
    at = lambda v, d: (F.col(v) + F.col("step") * (d / scale)).alias(v)
    return field.select("i", "j", "x", "y", steps).select("i", "j", "step", at("x", direction[0]), at("y", direction[1]))


def random_line_candidates(field: DataFrame, reach: int, u: Column, scale: float = 1.0) -> DataFrame:
    """The same along one of the 8 directions for each node, by a uniform number ``u`` of its row."""
    compass = F.array(*[F.struct(F.lit(float(a)).alias("di"), F.lit(float(b)).alias("dj")) for a, b in ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))])
    x = field.withColumn("_d", F.get(compass, F.floor(u * 8).cast("int"))).select("i", "j", "x", "y", "_d", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("step"))
    return x.select("i", "j", "step", *[(F.col(v) + F.col("step") * F.col(f"_d.{k}") / scale).alias(v) for v, k in (("x", "di"), ("y", "dj"))])


def windows_of(centres: DataFrame, radius: int) -> DataFrame:
    """Members (group, i, j) of the square windows around centres (group, i, j); a node of several is in the one of the smallest group."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    x = centres.select("group", "i", "j", F.explode(span).alias("di")).select("*", F.explode(span).alias("dj"))
    return x.groupBy((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")).agg(F.min("group").alias("group")).select("group", "i", "j")


def random_pick(field: DataFrame, cell: Column, share: float, u: Column) -> DataFrame:
    """A random subset of the nodes of each cell as members (group, i, j) of a joint move."""
    return field.where(u < share).select(cell.alias("group"), "i", "j")


def joint_moves(field: DataFrame, members: DataFrame, deltas: DataFrame | None, cost: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes (i, j, v) of a group (group, i, j) move together by the group's delta (group, delta); the group goes back unless its cost falls.

    Without ``deltas``, members (group, i, j, delta) have one each. ``cost`` adds a column cost to (i, j, v) rows. Groups don't share nodes.
    """
    own = field.join(members, ["i", "j"])
    if deltas is not None:
        own = own.join(deltas, "group")
    before = cost(own.select("i", "j", "v")).select("i", "j", F.col("cost").alias("before"))
    after = cost(own.select("i", "j", (F.col("v") + F.col("delta")).alias("v"))).select("i", "j", F.col("cost").alias("after"))
    both = own.select("group", "i", "j", "delta").join(before, ["i", "j"]).join(after, ["i", "j"])
    better = both.groupBy("group").agg(F.sum("before").alias("b"), F.sum("after").alias("a")).where("a < b").select("group")
    moved = both.join(better, "group").select("i", "j", "delta")
    return field.join(moved, ["i", "j"], "left").select("i", "j", (F.col("v") + F.coalesce("delta", F.lit(0.0))).alias("v"))


def expansion(field: DataFrame, value: float, cost: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every node takes the value if that is cheaper for it."""
    return winner_takes_all(cost(field.select("i", "j", "v").union(field.select("i", "j", F.lit(value).alias("v")))), ["i", "j"]).select("i", "j", "v")


def swap(field: DataFrame, a: float, b: float, cost: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes with one of two values take the other if that is cheaper for them."""
    two = field.where(F.col("v").isin(a, b))
    best = winner_takes_all(cost(two.select("i", "j", "v").union(two.select("i", "j", (F.lit(a + b) - F.col("v")).alias("v")))), ["i", "j"])
    return best.select("i", "j", "v").union(field.where(~F.col("v").isin(a, b)).select("i", "j", "v"))


def variable_descent(field: DataFrame, proposals: Sequence[Callable[[DataFrame, int], DataFrame]], cost: Callable[[DataFrame], DataFrame], most: int = 20) -> DataFrame:
    """Variable-neighbourhood descent: a round of proposals of the first kind; the next kind when a round does not lower the total, the first again when it does.

    ``cost`` is any sum of terms (length, smoothness, window or both). Ends when
    no kind helps, after ``most`` rounds at the latest.
    """
    total = lambda f: cost(f.select("i", "j", "v")).agg(F.sum("cost")).first()[0] or 0.0
    kind, now = 0, total(field)
    for k in range(most):
        if kind == len(proposals):
            break
        next_field = local_search(field, lambda f, turn: proposals[kind](f, k), cost, 2)  # both colours
        after = total(next_field)
        if after < now:
            field, now, kind = next_field, after, 0
        else:
            kind += 1
    return field


def descent(per_cell: Callable[[pd.DataFrame], pd.DataFrame], nodes: DataFrame, cell: Sequence[str], schema: str) -> DataFrame:
    """Moves of a whole cell by a function of its rows; a cell is bounded by its side."""
    return nodes.groupBy(*cell).applyInPandas(per_cell, schema)


# --- Populations: (agent, cost) and their states -----------------------------------------------------


def best_and_worst(population: DataFrame) -> DataFrame:
    return population.agg(F.min(F.struct("cost", "agent")).alias("b"), F.max(F.struct("cost", "agent")).alias("w")).select(F.col("b.agent").alias("best"), F.col("b.cost").alias("best_cost"), F.col("w.agent").alias("worst"), F.col("w.cost").alias("worst_cost"))


def _extreme(population: DataFrame, k: int, worst: bool) -> DataFrame:
    """The k best or worst (agent, cost, place from 1); only k rows are ranked."""
    order = [F.desc("cost"), F.desc("agent")] if worst else [F.col("cost"), F.col("agent")]
    return population.select("agent", "cost").orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def select(population: DataFrame, k: int) -> DataFrame:
    """The k best states overwrite the k worst: (agent, source, cost), source being the agent whose state it has."""
    best = _extreme(population, k, False).select("place", F.col("agent").alias("source"), F.col("cost").alias("new"))
    worst = _extreme(population, k, True)
    taken = worst.join(best, "place").select("agent", "source", F.col("new").alias("cost"))
    return taken.union(population.join(worst.select("agent"), "agent", "left_anti").select("agent", F.col("agent").alias("source"), "cost"))


def select_elite(population: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The best so far (agent, cost; one row) overwrites the k worst."""
    worst = _extreme(population, k, True).select("agent")
    taken = worst.join(F.broadcast(best.select(F.col("agent").alias("source"), "cost"))).select("agent", "source", "cost")
    return taken.union(population.join(worst, "agent", "left_anti").select("agent", F.col("agent").alias("source"), "cost"))


def crossed(a, b, u: Column) -> Column:
    """A child of two states (arrays of numbers): the first one's genes up to a cut by the uniform number ``u``, then the other's."""
    cut = F.floor(u * (F.size(a) + 1)).cast("int")
    return F.transform(a, lambda x, k: F.when(k < cut, x).otherwise(F.get(b, k)))


def mutated(state, u: Column, reach: float) -> Column:
    """A state with one gene, chosen by the uniform number ``u``, moved by up to ``reach`` either way."""
    at = u * F.size(state)
    return F.transform(state, lambda x, k: F.when(k == F.floor(at), x + ((at - F.floor(at)) * 2 - 1) * reach).otherwise(x))


def generation(population: DataFrame, k: int, reach: float, u: Column, v: Column) -> DataFrame:
    """One genetic generation of (agent, cost, state): the k best overwrite the k worst, and the children that took their place are crossed with their agent's own state and mutated.

    ``u`` and ``v`` are uniform numbers of an agent's row. Returns (agent, source, state).
    """
    chosen = select(population.select("agent", "cost"), k).select("agent", "source")
    other = population.select(F.col("agent").alias("source"), F.col("state").alias("_state"))
    both = population.join(chosen, "agent").join(other, "source")
    child = F.when(F.col("source") == F.col("agent"), F.col("state")).otherwise(mutated(crossed(F.col("_state"), F.col("state"), u), v, reach))
    return both.select("agent", "source", child.alias("state"))


def multi_start(spark, starts: int, construct: Callable[[np.random.Generator], np.ndarray], improve: Callable[[np.ndarray, np.random.Generator], np.ndarray], cost: Callable[[np.ndarray], float], seed: int, rounds: int = 1, restart: int = 5) -> DataFrame:
    """(agent, cost, state): for each start a constructed state, improved in rounds and taken up from its best every ``restart``; the same for a seed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for a in f["id"].tolist():
                rng = np.random.default_rng([seed, a])
                state = best = construct(rng)
                low = cost(best)
                for t in range(rounds):
                    state = improve(best if t % restart == 0 else state, rng)
                    if (now := cost(state)) < low:
                        best, low = state, now
                rows.append((a, low, [float(v) for v in best]))
            yield pd.DataFrame(rows, columns=["agent", "cost", "state"])

    return spark.range(starts).mapInPandas(run, "agent long, cost double, state array<double>")


def evolve(spark, agents: int, generations: int, k: int, construct, improve, cost, seed: int) -> DataFrame:
    """Generations of a memetic search: every agent improves its state, then the k best overwrite the k worst."""
    now = stored(multi_start(spark, agents, construct, improve, cost, seed, 0), "agents")

    def step(turn: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for a, low, state in zip(f["agent"].tolist(), f["cost"].tolist(), f["state"].tolist()):
                    new = improve(np.array(state), np.random.default_rng([seed, turn, a]))
                    c = cost(new)
                    out.append((a, c, [float(v) for v in new]) if c < low else (a, low, list(state)))
                yield pd.DataFrame(out, columns=["agent", "cost", "state"])

        return run

    for t in range(1, generations + 1):
        now = stored(now.mapInPandas(step(t), "agent long, cost double, state array<double>"), "agents")
        chosen = select(now.select("agent", "cost"), k)
        now = stored(chosen.select("agent", "source").join(now.select(F.col("agent").alias("source"), "cost", "state"), "source").select("agent", "cost", "state"), "agents")
    return now
