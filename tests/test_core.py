"""Points, trees, grids and sources on small fixtures, against plain Python."""

import glob
import itertools
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grovespark import queries as core
from grovespark.functions import geometry as g
from grovespark.operators import emst as tree, neighbors as nb, search, som, windows as win
from grovespark.operators.components import connected_components
from grovespark.runtime import stored
from grovespark.sources import binary, text

DATA = "/root/testdata/sf0.001"


def points(spark, xy):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(xy)), **{a: [float(p[k]) for p in xy] for k, a in enumerate("xyz"[: len(xy[0])])}}))


def prim(xy):
    n, total, seen = len(xy), 0.0, {0}
    while len(seen) < n:
        d, j = min((math.dist(xy[i], xy[j]), j) for i in seen for j in range(n) if j not in seen)
        total, seen = total + d, seen | {j}
    return total


@pytest.mark.parametrize("local", [tree.LOCAL_EDGES, 2])
@pytest.mark.parametrize(
    "xy",
    [
        [(0, 0), (0, 1), (1, 0), (1, 1)],
        [(k, 0) for k in range(9)],
        [(0.1 * k, 0.0) for k in range(6)] + [(50 + 0.1 * k, 9.0) for k in range(6)] + [(50.0, 9.0)] * 2,
    ],
)
def test_tree_has_the_least_length(spark, xy, local):
    e = tree.emst(points(spark, xy), ("x", "y"), local).toPandas()
    assert len(e) == len(xy) - 1 and e["length"].sum() == pytest.approx(prim(xy))


def test_tree_of_nothing_one_and_equal_points(spark):
    schema = "id long, x double, y double"
    assert tree.emst(spark.createDataFrame([], schema)).count() == 0
    assert tree.emst(points(spark, [(1, 2)])).count() == 0
    e = tree.emst(points(spark, [(1, 2)] * 4)).toPandas()
    assert sorted(zip(e.src, e.dst)) == [(0, 1), (0, 2), (0, 3)] and e["length"].sum() == 0
    holes = spark.createDataFrame([(0, 0.0, 0.0), (1, None, 1.0), (2, float("nan"), 1.0), (3, 1.0, 0.0)], schema)
    assert tree.emst(holes).toPandas().values.tolist() == [[0, 3, 1.0]]


def test_cones_hold_the_tree_and_search_is_exact(spark):
    rng = np.random.default_rng(5)
    xy = rng.random((60, 2)).round(3).tolist()
    p = points(spark, xy)
    cones = {tuple(sorted(r)) for r in nb.cone_candidates(p, ("x", "y")).select("src", "dst").toPandas().values.tolist()}
    assert {tuple(r) for r in tree.emst(p).select("src", "dst").toPandas().values.tolist()} <= cones
    found = nb.nearest(p, p, ("x", "y"), k=2).toPandas()
    for i in range(60):
        want = sorted((math.dist(xy[i], xy[j]), min(i, j), max(i, j), j) for j in range(60) if j != i)[:2]
        assert found[found.src == i].sort_values("rank").dst.tolist() == [w[3] for w in want]


def test_trees_and_searches_of_clusters_copies_and_far_points(spark):
    rng = np.random.default_rng(8)
    xyz = np.concatenate([rng.random((90, 3)), rng.random((60, 3)) * 0.01 + 1.5, np.repeat(rng.random((2, 3)), 8, 0), [[4.0, 0, 0]], rng.integers(0, 3, (20, 3))]).tolist()
    p = points(spark, xyz)
    for local in (tree.LOCAL_EDGES, 20):
        e = tree.emst(p, ("x", "y", "z"), local).toPandas()
        assert len(e) == len(xyz) - 1 and e["length"].sum() == pytest.approx(prim(xyz))
    found = nb.nearest(p, p, ("x", "y", "z"), k=3).toPandas()
    q = p.withColumn("v", F.col("id") % 7)
    odd = nb.nearest(q, q, ("x", "y", "z"), condition=F.col("t_v") == 0, extra=["v"]).toPandas()
    d2 = lambda i, j: sum((a - b) ** 2 for a, b in zip(xyz[i], xyz[j]))
    for i in range(len(xyz)):
        want = sorted((d2(i, j), min(i, j), max(i, j), j) for j in range(len(xyz)) if j != i)
        assert found[found.src == i].sort_values("rank").dst.tolist() == [w[3] for w in want[:3]]
        assert odd[odd.src == i].dst.tolist() == [w[3] for w in want if w[3] % 7 == 0][:1]


@pytest.mark.parametrize("name", ["emst_events", "emst_parts"])
def test_whole_tables_have_the_least_tree(spark, name):
    if name == "emst_events":
        p = pd.read_parquet(f"{DATA}/events.parquet")
        xy = np.stack([p.value, pd.to_datetime(p.ts).astype("datetime64[us]").astype("int64") / 3.6e9], 1)
    else:
        p = pd.read_parquet(f"{DATA}/part.parquet")
        xy = np.stack([p.p_size.astype(float), p.p_retailprice], 1)
    best, live, total = np.full(len(xy), np.inf), np.ones(len(xy), bool), 0.0
    at = 0
    for _ in range(len(xy) - 1):
        live[at] = False
        best = np.where(live, np.minimum(best, np.hypot(*(xy - xy[at]).T)), np.inf)
        at = int(best.argmin())
        total += best[at]
    got = core.QUERIES[name](spark, DATA).toPandas()
    assert len(got) == len(xy) - 1 and got["length"].sum() == pytest.approx(total, rel=1e-9)


def test_forests_of_arrays():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (5, 3), (40, 200), (300, 200)):
        e = {"a": rng.integers(0, n, m), "b": rng.integers(0, n, m), "src": np.arange(m), "dst": np.arange(m) + 1, "d2": rng.integers(0, 9, m).astype(float)}
        keep, nodes, roots = tree.minimum_forest(e)
        root = list(range(n))
        find = lambda v: v if root[v] == v else find(root[v])
        want = []
        for k in sorted(range(m), key=lambda k: (e["d2"][k], k)):
            a, b = find(int(e["a"][k])), find(int(e["b"][k]))
            if a != b:
                root[a] = b
                want.append(k)
        assert sorted(keep.tolist()) == sorted(want)
        assert len({(find(int(v)), int(r)) for v, r in zip(nodes, roots)}) == len({find(int(v)) for v in nodes}) == len(set(roots.tolist()))


def test_components_of_a_chain_a_loop_and_nulls(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200), (None, 3)], "src long, dst long")
    for local in (10**6, 0):
        got = {r.node: r.component for r in connected_components(e, local_edges=local).collect()}
        assert len(got) == 45 and all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[200] == 200


def test_single_linkage_and_rounds(spark):
    p = points(spark, [(0, 0), (1, 0), (2.5, 0), (10, 0), (11, 0)])
    e = tree.emst(p)
    cut = {r.id: r.cluster for r in tree.single_linkage(e, p, 3.0).collect()}
    assert cut == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    out, comp = tree.forest_rounds(e.withColumn("d2", F.col("length") * F.col("length")), p.select(F.col("id").alias("node")), 5)
    assert out.count() == 4 and comp.select("component").distinct().count() == 1


def test_rings_on_planar_shapes(spark):
    df = spark.createDataFrame([("0,0 4,0 4,3 0,3",), ("0,0 0,3 4,3 4,0",), ("0,0 2,2 2,0 0,2",), ("0,0 2,0 2,0 4,0 4,3 0,3",)], "t string").withColumn("ring", g.parsed_ring("t"))
    rows = df.select(g.ring_area("ring"), g.is_clockwise("ring"), g.is_simple("ring"), g.contains_point("ring", F.lit(1.0), F.lit(1.5)), F.size(g.repaired("ring")), F.size(g.closed_ring("ring"))).collect()
    assert [tuple(r) for r in rows[:2]] == [(12.0, False, True, True, 4, 5), (12.0, True, True, True, 4, 5)]
    assert rows[2][2] is False and rows[3][4] == 4
    two = spark.range(1).select(g.circle_circle(F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(6.0), F.lit(0.0), F.lit(5.0)).alias("p")).first().p
    assert sorted((round(q.x, 6), round(q.y, 6)) for q in two) == [(3.0, -4.0), (3.0, 4.0)]


def test_hexagons_hold_their_points(spark):
    rng = np.random.default_rng(2)
    xy = (rng.random((200, 2)) * 40 - 20).tolist()
    q, r = g.hexagon_cell("x", "y", F.lit(3.0))
    for x, y, a, b in points(spark, xy).select("x", "y", q, r).collect():
        centre = lambda a, b: (3 * math.sqrt(3) * (a + b / 2), 3 * 1.5 * b)
        here = math.dist((x, y), centre(a, b))
        assert all(here <= math.dist((x, y), centre(a + i, b + j)) + 1e-9 for i, j in itertools.product((-1, 0, 1), repeat=2))


def test_local_search_never_gets_worse_and_selection_overwrites(spark):
    net = spark.createDataFrame([(i, j, float((3 * i + j) % 5), 0.0) for i in range(4) for j in range(4)], "i long, j long, own double, v double")
    cost = lambda rows: rows.join(net.select("i", "j", "own"), ["i", "j"]).select("i", "j", "v", F.abs(F.col("v") - F.col("own")).alias("cost"))
    out = search.local_search(net.select("i", "j", "v"), lambda f, k: search.random_candidates(f, 3.0, k), cost, 3)
    assert cost(out).agg(F.sum("cost")).first()[0] < cost(net.select("i", "j", "v")).agg(F.sum("cost")).first()[0]
    pop = spark.createDataFrame([(k, float(k)) for k in range(6)], "agent long, cost double")
    assert {(r.agent, r.source) for r in search.select(pop, 2).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 0), (4, 1)}


def test_schedules_and_samples(spark):
    s = som.schedule(1.0, 0.01, 4)
    assert s[0] == 1.0 and all(a > b for a, b in zip(s, s[1:]))
    items = spark.createDataFrame([(k, k % 2, 1.0 + k) for k in range(20)], "id long, grp long, w double")
    a, b = (sorted(map(tuple, som.weighted_sample(items, "grp", F.col("w"), 3, 5).collect())) for _ in range(2))
    assert a == b and len(a) == 6


def test_text_and_binary_round_trips(spark, tmp_path):
    (tmp_path / "a.tsp").write_text("NAME : a\nCOMMENT : c\nTYPE : TSP\nDIMENSION : 2\nEDGE_WEIGHT_TYPE : EUC_2D\nNODE_COORD_SECTION\n1 2.5 3e1\n2 -1 4\nEOF\n")
    assert [tuple(r) for r in text.read_points(spark, str(tmp_path / "a.tsp")).orderBy("id").collect()] == [(1, 2.5, 30.0), (2, -1.0, 4.0)]
    (tmp_path / "b.3d").write_text("2\n1 2 3\n4 5 6\n")
    assert text.read_points(spark, str(tmp_path / "b.3d")).orderBy("id").collect()[1].z == 6.0
    grid = spark.createDataFrame([(i, j, i + 10.0 * j) for i in range(3) for j in range(2)], "i long, j long, v double")
    text.write_grid(grid, str(tmp_path / "g"), ["v"])
    back = text.read_grid(spark, str(tmp_path / "g"), ["v"]).select("i", "j", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, grid.collect()))
    edges, nodes = spark.createDataFrame([(0, 1), (1, 3)], "src long, dst long"), spark.range(4)
    text.write_links(edges, nodes, str(tmp_path / "l"))
    assert sorted(map(tuple, text.read_links(spark, str(tmp_path / "l")).collect())) == [(0, 1), (1, 3)]
    text.write_links(edges, nodes, str(tmp_path / "l2"), 2)
    assert sorted(map(tuple, text.read_links(spark, str(tmp_path / "l2")).collect())) == [(0, 1), (1, 3)]
    (tmp_path / "c.cfg").write_text("# note\n[one]\na = 1 ; why\n[two]\nb=x y\n")
    assert {tuple(r) for r in text.read_config(spark, str(tmp_path / "c.cfg")).collect()} == {("one", "a", "1"), ("two", "b", "x y")}
    flow = np.arange(12, dtype=np.float32).reshape(2, 3, 2)
    (tmp_path / "f.flo").write_bytes(binary.encode_flow(flow))
    assert {(r.i, r.j): (r.u, r.v) for r in binary.read_flow(spark, str(tmp_path / "f.flo")).collect()} == {(i, j): tuple(map(float, flow[j, i])) for i in range(3) for j in range(2)}
    v = np.arange(6, dtype=float).reshape(2, 3)
    assert (binary.decode_pfm(binary.encode_pfm(v)) == v).all() and (binary.decode_pnm(binary.encode_pnm(v)) == v).all()


FAST = ["points_bbox", "find_cell_hexagon", "cell_density", "kmeans_step", "grid_sobel", "grid_weighted_median", "cross_check", "rgb_to_lab", "ga_select", "polygon_measures", "roulette_pick", "emst_edges", "windowed_cells"]


@pytest.mark.parametrize("name", FAST)
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = core.QUERIES[name](spark, DATA).toPandas(), con.sql(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-6)


def image(spark, wide=70, high=66, missing=()):
    """A grid of more than one block with its rows as plain Python: (i, j) -> (v, c)."""
    rng = np.random.default_rng(3)
    rows = {(i, j): (float(rng.integers(0, 9)), float(rng.random())) for i in range(wide) for j in range(high) if (i, j) not in missing}
    return stored(spark.createDataFrame([(i, j, v, c) for (i, j), (v, c) in rows.items()], "i long, j long, v double, c double")), rows


def around(rows, i, j, radius, size):
    """(di, dj, v, c) of a window with mirrored borders."""
    back = lambda x, n: -x if x < 0 else 2 * n - 2 - x if x >= n else x
    places = [(a, b, (back(i + a, size[0]), back(j + b, size[1]))) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    return [(a, b, *rows[p]) for a, b, p in places if p in rows]


def unsent(df):
    """The rows of a plan that sends no side of a join to the driver, however small the tables look."""
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    return {(r.i, r.j): r[2] for r in df.collect()}


def test_holes_are_filled_across_blocks_without_broadcasts(spark):
    x, rows = image(spark)
    hidden = {p for p, (v, _) in rows.items() if v < 3} | {(i, j) for i in range(55, 68) for j in range(58, 66)}
    holes = spark.createDataFrame([(i, j, v, (i, j) in hidden) for (i, j), (v, _) in rows.items()] + [(None, 1, 4.0, True)], "i long, j long, v double, occluded boolean")
    got = unsent(win.fill_occluded(stored(holes), 4))
    assert got.pop((None, 1)) == 4.0 and set(got) == set(rows)
    for (i, j), (v, _) in rows.items():
        near = sorted((max(abs(a - i), abs(b - j)), rows[a, b][0]) for a in range(i - 4, i + 5) for b in range(j - 4, j + 5) if (a, b) in rows and (a, b) not in hidden)
        assert got[i, j] == (near[0][1] if (i, j) in hidden and near else v)


def test_sobel_by_shares_without_broadcasts(spark):
    x, rows = image(spark, missing={(5, 5), (0, 1)})
    got = unsent(win.sobel(x, (70, 66)))
    for i, j in rows:
        near = around(rows, i, j, 1, (70, 66))
        gi, gj = sum(v * a * (2 - abs(b)) for a, b, v, _ in near), sum(v * b * (2 - abs(a)) for a, b, v, _ in near)
        assert got[i, j] == pytest.approx(math.hypot(gi, gj))
    assert set(got) == set(rows)
    assert unsent(win.sobel(spark.createDataFrame([(3, 0, 2.0)], "i long, j long, v double"), (40, 1))) == {(3, 0): 0.0}  # as the SQL: no neighbour, no slope


def test_median_by_blocks_without_broadcasts(spark):
    x, rows = image(spark, missing={(5, 5), (0, 1)})
    got = unsent(win.median_filter(x, 2, (70, 66), F.col("v") > 4))
    assert got == {(i, j): float(np.median([n[2] for n in around(rows, i, j, 2, (70, 66))])) if v > 4 else v for (i, j), (v, _) in rows.items()}


def test_weighted_median_by_blocks_without_broadcasts(spark):
    x, rows = image(spark, missing={(5, 5), (0, 1)})
    want = {}
    for (i, j), (_, c) in rows.items():
        near = sorted((n[2], math.exp(-((n[0] ** 2 + n[1] ** 2) / 9 + (n[3] - c) ** 2 / 0.04))) for n in around(rows, i, j, 2, (70, 66)))
        half, run = sum(w for _, w in near) / 2, 0.0
        for v, w in near:
            run += w
            if run >= half:
                want[i, j] = v
                break
    assert unsent(win.weighted_median_filter(x, 2, (70, 66), 3.0, 0.2)) == want


def test_large_moves_of_a_high_grid_agree_with_sql(spark, tmp_path):
    con = duckdb.connect()  # places 0..15 of the rows from 0 and, past 1000 cells, from 8000 on
    con.sql(f"COPY (SELECT * REPLACE (p_partkey % 640 + k * 320000 AS p_partkey) FROM '{DATA}/part.parquet', range(2) r(k) WHERE p_partkey < 640) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = {(i, j): v for i, j, v in con.sql(f"SELECT i, j, v FROM ({core.ORACLE_SQL['large_moves']})").fetchall()}
    got = core.large_moves(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.i, r.j): r.v for r in got} == want


def test_cones_are_exact_without_a_search_as_wide_as_the_box(spark, monkeypatch):
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.normal(size=(90, 3)), rng.integers(0, 3, (30, 3)), np.repeat([[0.5, 0.5, 0.5]], 12, 0)]).round(2)
    within = nb.pairs_within

    def narrow(queries, data, axes, radius, *more):
        assert radius < 1, "queries with an empty cone are joined with all points"
        return within(queries, data, axes, radius, *more)

    monkeypatch.setattr(nb, "pairs_within", narrow)
    monkeypatch.setattr(nb, "CHUNK", 16, raising=False)
    want = {}
    for i, a in enumerate(xyz):
        for j, b in enumerate(xyz):
            d, top = b - a, np.abs(b - a).max()
            for axis, face in itertools.product(range(3), (1, -1)):
                rest = [v for k, v in enumerate(d) if k != axis]
                for s in itertools.product((1, -1), repeat=2):
                    if top > 0 and d[axis] * face == top and rest[0] * s[0] >= 0 and rest[1] * s[1] >= 0:
                        key = (i, (2 * axis + (face < 0)) * 4 + (s[0] < 0) + 2 * (s[1] < 0))
                        d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
                        want[key] = min(want.get(key, (math.inf,)), (d2, min(i, j), max(i, j), j))
    got = {(r.src, r.cone): r.dst for r in nb.cone_candidates(points(spark, xyz.tolist()), ("x", "y", "z")).collect()}
    assert got == {k: v[3] for k, v in want.items()}
