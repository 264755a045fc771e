"""Queries over the star-schema tables, each with the SQL that says the same where SQL can.

Points come from columns: E3 from the first three numbers of an embedding, S2
from suppliers, C2 from customers, EV2 from events; grids from parts, 40 wide.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grovespark.functions import geometry as g
from grovespark.operators import emst as tree, neighbors as nb, search, som, windows as win
from grovespark.operators.components import connected_components
from grovespark.runtime import stored
from grovespark.streaming.cells import windowed_density

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
XYZ, XY = ("x", "y", "z"), ("x", "y")
WIDE = 40

E3 = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS BIGINT) AS label FROM embeddings)"
S2 = "p AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)"
C2 = "p AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y, c_mktsegment AS segment FROM customer)"
G = f"g AS (SELECT p_partkey % {WIDE} AS i, p_partkey // {WIDE} AS j, CAST(p_size AS DOUBLE) AS v, p_retailprice AS c, p_partkey AS id FROM part), s AS (SELECT max(j) + 1 AS h FROM g)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
D2XY = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
PRIM = f"""WITH RECURSIVE {E3}, t(step, tree, u, v, d2) AS (
  SELECT 0, [min(id)], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM p
  UNION ALL
  SELECT step + 1, list_append(tree, v), u, v, d2 FROM (
    SELECT t.step, t.tree, a.id AS u, b.id AS v, {D2} AS d2 FROM t, p a, p b
    WHERE list_contains(t.tree, a.id) AND NOT list_contains(t.tree, b.id)
    ORDER BY {D2}, least(a.id, b.id), greatest(a.id, b.id) LIMIT 1)),
e AS MATERIALIZED (SELECT least(u, v) AS src, greatest(u, v) AS dst, d2 FROM t WHERE u IS NOT NULL)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str, name: str) -> Column:
    return F.round(g.c(x), 6).alias(name)


def e3(spark, d) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[e[k].cast("double").alias(a) for k, a in enumerate(XYZ)], F.col("label").cast("long").alias("label"))


def s2(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))


def c2(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.col("c_mktsegment").alias("segment"))


def grid(spark, d) -> tuple[DataFrame, tuple[int, int]]:
    """Parts as pixels (i, j, v size, c price, id), and the grid's size."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    x = p.select((k % WIDE).alias("i"), F.floor(k / WIDE).alias("j"), F.col("p_size").cast("double").alias("v"), F.col("p_retailprice").alias("c"), F.col("p_partkey").alias("id"))
    return x, (WIDE, int(x.agg(F.max("j")).first()[0] or 0) + 1)


# --- Points and cells --------------------------------------------------------------------------------


@query(f"WITH {E3} SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM p")
def points_bbox(spark, d):
    return nb.bounding_box(e3(spark, d), XYZ)


@query(f"""WITH {E3}, b AS (SELECT count(*) AS n, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) - min(x) AS w, max(y) - min(y) AS h, max(z) - min(z) AS d FROM p)
SELECT id, round((x - lx) * u, 6) AS x, round((y - ly) * u, 6) AS y, round((z - lz) * u, 6) AS z FROM p, (SELECT *, (ceil(pow(n * w * w / (h * d), 0.333)) + 1) / w AS u FROM b)""")
def normalize_points(spark, d):
    return nb.normalise(e3(spark, d), XYZ).select("id", *[r6(a, a) for a in XYZ])


@query(f"WITH {S2} SELECT id, CAST(floor((x - 0.0 + 100.0 / 2) / 100.0) AS BIGINT) AS cx, CAST(floor((y - 0.0 + 5.0 / 2) / 5.0) AS BIGINT) AS cy FROM p")
def find_cell(spark, d):
    x, y = g.quad_cell(["x"], [F.lit(0.0)], F.lit(100.0)), g.quad_cell(["y"], [F.lit(0.0)], F.lit(5.0))
    return s2(spark, d).select("id", x[0].alias("cx"), y[0].alias("cy"))


@query(f"WITH {S2} SELECT id, CAST(floor((x + y) / 64.0 + 0.5) AS BIGINT) AS cu, CAST(floor((y - x) / 64.0 + 0.5) AS BIGINT) AS cv FROM p")
def find_cell_diamond(spark, d):
    u, v = g.diamond_cell("x", "y", F.lit(64.0))
    return s2(spark, d).select("id", u.alias("cu"), v.alias("cv"))


@query(f"""WITH {S2}, h AS (SELECT id, (x * {3**0.5 / 3!r} - y / 3) / 50.0 AS q, y * 2 / 3 / 50.0 AS r FROM p),
k AS (SELECT *, -q - r AS s, floor(q + 0.5) AS a, floor(r + 0.5) AS b, floor(-q - r + 0.5) AS c FROM h), m AS (SELECT *, abs(a - q) AS da, abs(b - r) AS db, abs(c - s) AS dc FROM k)
SELECT id, CAST(CASE WHEN da > db AND da > dc THEN -b - c ELSE a END AS BIGINT) AS cq, CAST(CASE WHEN da > db AND da > dc THEN b WHEN db > dc THEN -a - c ELSE b END AS BIGINT) AS cr FROM m""")
def find_cell_hexagon(spark, d):
    q, r = g.hexagon_cell("x", "y", F.lit(50.0))
    return s2(spark, d).select("id", q.alias("cq"), r.alias("cr"))


_DENSITY = f"{C2}, cells AS (SELECT CAST(floor((x + 500.0) / 1000.0) AS BIGINT) AS cx, CAST(floor((y + 500.0) / 1000.0) AS BIGINT) AS cy, count(*) AS n, sum(x / 1000) AS density, sum(1 / (1 + x / 1000 * (x / 1000))) AS opposite, count(*) FILTER (x > 0) AS n_active FROM p GROUP BY 1, 2)"


def _density(spark, d) -> DataFrame:
    return nb.cell_density(c2(spark, d), XY, 1000.0, F.col("x") / 1000, F.col("x") > 0)


@query(f"WITH {_DENSITY} SELECT cx, cy, n, round(density, 6) AS density, round(opposite, 6) AS opposite, n_active FROM cells")
def cell_density(spark, d):
    return _density(spark, d).select("cx", "cy", "n", r6("density", "density"), r6("opposite", "opposite"), "n_active")


@query(f"WITH {_DENSITY} SELECT round(max(density), 6) AS most, round(sum(density), 6) AS total FROM cells")
def cell_density_max(spark, d):
    return _density(spark, d).agg(F.round(F.max("density"), 6).alias("most"), F.round(F.sum("density"), 6).alias("total"))


@query(f"""WITH {S2} SELECT a.id, round(abs(a.x - b.x) + abs(a.y - b.y), 6) AS l1, round(sqrt({D2XY}), 6) AS l2, round({D2XY}, 6) AS l2_squared, round(a.x * b.x + a.y * b.y, 4) AS scalar FROM p a, p b WHERE b.id = 1""")
def distances(spark, d):
    p = s2(spark, d)
    one = p.where("id = 1").select(F.col("x").alias("bx"), F.col("y").alias("by"))
    a, b = ["x", "y"], ["bx", "by"]
    return p.join(F.broadcast(one)).select("id", r6(g.manhattan(a, b), "l1"), r6(g.euclidean(a, b), "l2"), r6(g.squared(a, b), "l2_squared"), F.round(g.dot(a, b), 4).alias("scalar"))


# --- Neighbour search --------------------------------------------------------------------------------


def _knn_sql(k: int, where: str = "true", points: str = E3) -> str:
    return f"""WITH {points}, j AS (SELECT a.id AS src, b.id AS dst, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, least(a.id, b.id), greatest(a.id, b.id)) AS k FROM p a, p b WHERE a.id <> b.id AND {where})
SELECT src, dst, round(sqrt(d2), 6) AS length, k FROM j WHERE k <= {k}"""


def _found(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", r6(F.sqrt("d2"), "length"), F.col("rank").cast("long").alias("k"))


@query(_knn_sql(1))
def nn_1(spark, d):
    p = e3(spark, d)
    return _found(nb.nearest(p, p, XYZ))


@query(_knn_sql(1, "b.label % 2 = 0"))
def nn_1_conditional(spark, d):
    p = e3(spark, d)
    return _found(nb.nearest(p, p, XYZ, condition=F.col("t_label") % 2 == 0, extra=["label"]))


@query(_knn_sql(1, "a.label <> b.label"))
def nn_other_label(spark, d):
    p = e3(spark, d)
    return _found(nb.nearest(p, p, XYZ, condition=F.col("s_label") != F.col("t_label"), extra=["label"]))


@query(_knn_sql(3))
def knn(spark, d):
    p = e3(spark, d)
    return _found(nb.nearest(p, p, XYZ, k=3))


_RADIUS = f"{E3}, e AS (SELECT a.id AS src, b.id AS dst, sqrt({D2}) AS length, a.label AS la, b.label AS lb FROM p a, p b WHERE a.id < b.id AND {D2} <= 0.04 * 0.04)"


@query(f"WITH {_RADIUS} SELECT src, dst, round(length, 6) AS length FROM e")
def radius_graph(spark, d):
    return nb.radius_graph(e3(spark, d), XYZ, 0.04).select("src", "dst", r6("length", "length"))


@query(f"""WITH RECURSIVE {_RADIUS}, r(a, b) AS (SELECT id, id FROM p UNION SELECT r.a, CASE WHEN e.src = r.b THEN e.dst ELSE e.src END FROM r JOIN e ON e.src = r.b OR e.dst = r.b)
SELECT a AS id, min(b) AS component FROM r GROUP BY a""")
def components(spark, d):
    p = e3(spark, d)
    comp = connected_components(nb.radius_graph(p, XYZ, 0.04)).withColumnRenamed("node", "id")
    return p.select("id").join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query(f"WITH {_RADIUS} SELECT src, dst, round(length, 6) AS length FROM e WHERE abs(la - lb) <= 2")
def filter_edges_by_attr(spark, d):
    p = e3(spark, d)
    return tree.filter_edges(nb.radius_graph(p, XYZ, 0.04), p.select("id", F.col("label").alias("v")), 2).select("src", "dst", r6("length", "length"))


@query(f"WITH {_RADIUS} SELECT src AS id FROM e WHERE la <> lb UNION SELECT dst FROM e WHERE la <> lb")
def boundary_nodes(spark, d):
    p = e3(spark, d)
    return tree.boundary_nodes(nb.radius_graph(p, XYZ, 0.04), p.select("id", "label"))


def _cone_sql() -> str:
    d = ["(b.x - a.x)", "(b.y - a.y)", "(b.z - a.z)"]
    top = "greatest(" + ", ".join(f"abs({v})" for v in d) + ")"
    rows = []
    for i in range(3):
        for f, face in enumerate((1, -1)):
            for s1 in (1, -1):
                for s2_ in (1, -1):
                    o = [v for k, v in enumerate(d) if k != i]
                    code = (2 * i + f) * 4 + (s1 < 0) + 2 * (s2_ < 0)
                    rows.append(f"CASE WHEN {d[i]} * {face} = {top} AND {o[0]} * {s1} >= 0 AND {o[1]} * {s2_} >= 0 THEN {code} END")
    return f"""WITH {E3}, j AS (SELECT a.id AS src, b.id AS dst, {D2} AS d2, unnest([{', '.join(rows)}]) AS cone FROM p a, p b WHERE a.id <> b.id AND {D2} > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY src, cone ORDER BY d2, least(src, dst), greatest(src, dst)) AS k FROM j WHERE cone IS NOT NULL)
SELECT src, CAST(cone AS BIGINT) AS cone, dst, round(sqrt(d2), 6) AS length FROM k WHERE k = 1"""


@query(_cone_sql())
def cone_candidates(spark, d):
    return nb.cone_candidates(e3(spark, d), XYZ).select("src", F.col("cone").cast("long").alias("cone"), "dst", r6(F.sqrt("d2"), "length"))


# --- Spanning forests and trees ------------------------------------------------------------------------


@query(f"""WITH {E3}, j AS (SELECT a.label AS component, least(a.id, b.id) AS lo, greatest(a.id, b.id) AS hi, {D2} AS d2 FROM p a, p b WHERE a.label <> b.label),
k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY d2, lo, hi) AS k FROM j) SELECT component, lo, hi, round(sqrt(d2), 6) AS length FROM k WHERE k = 1""")
def find_min_pair(spark, d):
    p = e3(spark, d)
    near = nb.nearest(p, p, XYZ, condition=F.col("s_label") != F.col("t_label"), extra=["label"])
    by = p.select("id", "label")
    pairs = near.join(by.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(by.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    return tree.find_min_pair(pairs).select("component", "lo", "hi", r6(F.sqrt("d2"), "length"))


@query(f"""WITH {E3}, k AS (SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, sqrt({D2}) AS length, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, least(a.id, b.id), greatest(a.id, b.id)) AS k FROM p a, p b WHERE a.id <> b.id)
SELECT DISTINCT src, dst, round(length, 6) AS length FROM k WHERE k = 1""")
def emsf_round1(spark, d):
    p = e3(spark, d)
    edges = tree.emst(p, XYZ).withColumn("d2", F.col("length") * F.col("length"))
    out, _ = tree.forest_rounds(edges, p.select(F.col("id").alias("node")), 1)
    return out.select("src", "dst", r6(F.sqrt("d2"), "length"))


@query(PRIM + " SELECT src, dst, round(sqrt(d2), 6) AS length FROM e")
def emst_edges(spark, d):
    return tree.emst(e3(spark, d), XYZ).select("src", "dst", r6("length", "length"))


@query(PRIM + " SELECT count(*) AS size, round(sum(sqrt(d2)), 5) AS length FROM e")
def emst_summary(spark, d):
    return tree.emst_summary(tree.emst(e3(spark, d), XYZ)).select("size", F.round("length", 5).alias("length"))


@query(PRIM + ", b AS (SELECT src AS id, d2 FROM e UNION ALL SELECT dst, d2 FROM e) SELECT id, count(*) AS degree, round(sum(sqrt(d2)), 5) AS length FROM b GROUP BY id")
def emst_degree(spark, d):
    p = e3(spark, d)
    return tree.node_degree(tree.emst(p, XYZ), p).select("id", "degree", F.round("length", 5).alias("length"))


@query(PRIM + ", r(a, b) AS (SELECT id, id FROM p UNION SELECT r.a, CASE WHEN e.src = r.b THEN e.dst ELSE e.src END FROM r JOIN e ON (e.src = r.b OR e.dst = r.b) AND sqrt(e.d2) <= 0.045) SELECT a AS id, min(b) AS cluster FROM r GROUP BY a")
def single_linkage(spark, d):
    p = e3(spark, d)
    return tree.single_linkage(tree.emst(p, XYZ), p, 0.045)


@query()
def emst_parts(spark, d):
    """Whole parts table as points (size, price), repeated points included."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return tree.emst(p, XY)


@query()
def emst_events(spark, d):
    """Whole events table as points (value, time in hours)."""
    p = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("y"))
    return tree.emst(p, XY)


@query("""WITH p AS (SELECT c_nationkey AS tour, c_custkey AS place, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y FROM customer),
n AS (SELECT tour, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY tour ORDER BY place))
SELECT CAST(tour AS BIGINT) AS tour, round(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 4) AS length FROM n GROUP BY tour""")
def tour_length(spark, d):
    p = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("tour"), F.col("c_custkey").alias("place"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    return tree.closed_tour_length(p).select("tour", F.round("length", 4).alias("length"))


# --- Clusters, maps, sampling ---------------------------------------------------------------------------

_ASSIGN = f"{E3}, k AS (SELECT * FROM p WHERE id < 8), j AS (SELECT a.id, b.id AS centre, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS r FROM p a, k b), own AS (SELECT * FROM j WHERE r = 1)"


@query(f"WITH {_ASSIGN} SELECT id, centre, round(d2, 6) AS d2 FROM own")
def kmeans_assign(spark, d):
    p = e3(spark, d)
    return som.assign(p, p.where("id < 8"), XYZ).select("id", "centre", r6("d2", "d2"))


@query(f"""WITH {_ASSIGN}, m AS (SELECT centre AS id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n FROM own JOIN p USING (id) GROUP BY centre)
SELECT k.id, round(coalesce(mx, x), 6) AS x, round(coalesce(my, y), 6) AS y, round(coalesce(mz, z), 6) AS z, coalesce(n, 0) AS n FROM k LEFT JOIN m USING (id)""")
def kmeans_step(spark, d):
    p = e3(spark, d)
    return som.kmeans_step(p, p.where("id < 8"), XYZ).select("id", *[r6(a, a) for a in XYZ], "n")


@query(f"WITH {_ASSIGN} SELECT round(sum(d2), 5) AS cost, round(avg(d2), 6) AS mean_cost FROM own")
def kmeans_cost(spark, d):
    p = e3(spark, d)
    return som.kmeans_cost(p, p.where("id < 8"), XYZ).select(F.round("cost", 5).alias("cost"), r6("mean_cost", "mean_cost"))


@query(f"WITH {_ASSIGN} SELECT own.id, centre, k.label FROM own JOIN k ON k.id = centre")
def voronoi_labels(spark, d):
    p = e3(spark, d)
    return som.injected(som.assign(p, p.where("id < 8"), XYZ), p.where("id < 8"), ["label"])


_PULL = "CASE WHEN k IS NULL THEN {0} ELSE {0} + k{0} - k * {0} END"


@query(f"""WITH {G}, o AS (SELECT di, dj, greatest(abs(di), abs(dj)) AS r FROM range(-3, 4) a(di), range(-3, 4) b(dj)),
a AS (SELECT i, j, c / 100 AS px, v AS py FROM g), u AS (SELECT i + di AS i, j + dj AS j, px, py, exp(-(r * r) / (1.5 * 1.5)) * 0.1 AS k FROM a, o),
t AS (SELECT i, j, sum(k) AS k, sum(k * px) AS kx, sum(k * py) AS ky FROM u GROUP BY i, j), n AS (SELECT i, j, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y FROM g)
SELECT n.i, n.j, round({_PULL.format('x')}, 6) AS x, round({_PULL.format('y')}, 6) AS y FROM n LEFT JOIN t ON n.i = t.i AND n.j = t.j""")
def som_trigger_step(spark, d):
    x, _ = grid(spark, d)
    net = x.select("i", "j", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.lit(False).alias("fixed"))
    pull = x.select("i", "j", (F.col("c") / 100).alias("px"), F.col("v").alias("py"))
    return som.som_trigger(net, pull, 0.1, 1.5).select("i", "j", r6("x", "x"), r6("y", "y"))


@query(f"""WITH {G}, l AS (SELECT i, j, CAST(v AS BIGINT) % 3 AS label, i * 2147483648 + j AS id FROM g),
e AS (SELECT a.id AS a, b.id AS b FROM l a JOIN l b ON a.label = b.label AND ((a.i = b.i AND abs(a.j - b.j) = 1) OR (a.j = b.j AND abs(a.i - b.i) = 1))),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT id, id FROM l UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS id, min(b) AS region FROM r GROUP BY a),
w AS (SELECT l.*, region, count(*) OVER (PARTITION BY region) AS n FROM l JOIN reach USING (id)),
nb AS (SELECT a.region, min(b.label) AS other FROM w a JOIN w b ON ((a.i = b.i AND abs(a.j - b.j) = 1) OR (a.j = b.j AND abs(a.i - b.i) = 1)) WHERE a.label <> b.label GROUP BY a.region)
SELECT w.i, w.j, w.region, CASE WHEN n <= 4 AND other IS NOT NULL THEN other ELSE label END AS label FROM w LEFT JOIN nb USING (region)""")
def label_regions(spark, d):
    x, _ = grid(spark, d)
    return som.label_regions(x.select("i", "j", (F.col("v").cast("long") % 3).alias("label")), 4)


@query(f"""WITH {G}, l AS (SELECT i, j, CAST(v AS BIGINT) % 3 AS label FROM g)
SELECT a.i, a.j FROM l a JOIN l b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 WHERE a.label <> b.label GROUP BY a.i, a.j HAVING count(*) >= 5""")
def contours(spark, d):
    x, _ = grid(spark, d)
    return win.contours(x.select("i", "j", (F.col("v").cast("long") % 3).alias("label")), 5)


@query("""WITH p AS (SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal + 1000 AS w, (c_nationkey * 37 % 101) / 101.0 AS u FROM customer),
r AS (SELECT *, sum(w) OVER (PARTITION BY nation ORDER BY id) AS run, sum(w) OVER (PARTITION BY nation) AS total FROM p)
SELECT CAST(nation AS BIGINT) AS nation, min(id) AS id FROM r WHERE run >= u * total GROUP BY nation""")
def roulette_pick(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation"), (F.col("c_acctbal") + 1000).alias("w"))
    return som.roulette(p, "nation", F.col("w"), (F.col("nation") * 37 % 101) / 101.0)


_U = "(((({0}) + {1}) % 2147483647 * 48271 + 11) % 2147483647 + 0.5) / 2147483647.0"


@query(f"""WITH p AS (SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal + 1001 AS w, {_U.format('c_custkey', 7)} AS u FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY ln(u) / w DESC, id) AS r FROM p) SELECT id, nation, w FROM r WHERE r <= 3""")
def weighted_sample(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") + 1001).alias("w"))
    return som.weighted_sample(p, "nation", F.col("w"), 3, 7, g.linear_uniform("id", 7))


@query(f"""WITH u AS (SELECT c_custkey AS id, {_U.format('c_custkey', 1)} AS u, {_U.format('c_custkey', 2)} AS v FROM customer)
SELECT id, round(-3 + u * 8, 6) AS between_, CAST(floor(u * 12) AS BIGINT) AS index_, u < 0.3 AS occurs, round(-ln(u), 6) AS expo, round(sqrt(-2 * ln(u)) * cos(2 * pi() * v), 6) AS normal_, CAST(CASE WHEN u < 0.2 THEN 0 WHEN u < 0.7 THEN 1 ELSE 2 END AS BIGINT) AS option FROM u""")
def variates(spark, d):
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), g.linear_uniform("c_custkey", 1).alias("u"), g.linear_uniform("c_custkey", 2).alias("v"))
    return x.select("id", r6(g.uniform_between("u", -3.0, 5.0), "between_"), g.uniform_index("u", 12).alias("index_"), g.occurs("u", 0.3).alias("occurs"), r6(g.exponential("u"), "expo"), r6(g.normal("u", "v"), "normal_"), g.choose("u", [2.0, 5.0, 3.0]).alias("option"))


@query(f"""WITH RECURSIVE {G}, w0 AS (SELECT id, i, j, v FROM g WHERE i % 4 = 1 AND j % 4 = 1), """ + ", ".join(
    f"w{k + 1} AS (SELECT w.id, coalesce(n.i, w.i) AS i, coalesce(n.j, w.j) AS j, coalesce(n.v, w.v) AS v FROM w{k} w LEFT JOIN g n ON n.i = w.i + ({di}) AND n.j = w.j + ({dj}) AND n.v < w.v)" for k, (di, dj) in enumerate(som.STEPS)
) + " SELECT id, i, j, v FROM w8")
def perturbed_seeds(spark, d):
    x, _ = grid(spark, d)
    return som.perturbed_seeds(x.where("i % 4 = 1 AND j % 4 = 1").select("id", "i", "j"), x)


@query(f"""WITH {G}, c AS (SELECT DISTINCT i // 8 AS ci, j // 8 AS cj FROM g), o AS (SELECT di, dj FROM range(-3, 4) a(di), range(-3, 4) b(dj) WHERE greatest(abs(di), abs(dj)) >= 2)
SELECT DISTINCT CAST(ci * 2 + 1 + di AS BIGINT) AS i, CAST(cj * 2 + dj AS BIGINT) AS j FROM c, o WHERE ci * 2 + 1 + di BETWEEN 0 AND 19 AND cj * 2 + dj BETWEEN 0 AND 29""")
def fixed_borders(spark, d):
    x, _ = grid(spark, d)
    cells = x.select(F.floor(F.col("i") / 8).alias("i"), F.floor(F.col("j") / 8).alias("j")).distinct()
    return som.fixed_borders(cells, (20, 30), 3, (5, 4))


@query(f"WITH {G}, n AS (SELECT id, (SELECT count(*) FROM g) AS t FROM g) SELECT id, id // ((t + 6) // 7) AS cell, id % ((t + 6) // 7) AS place FROM n")
def shared_out(spark, d):
    x, _ = grid(spark, d)
    return som.shared_out(x.select("id"), x.count(), 7).select("id", "cell", "place")


_LINKS = "e AS (SELECT l_orderkey % 400 AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT src, dst FROM e UNION SELECT dst, src FROM e)"


def _links(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") % 400).alias("src"), F.col("l_suppkey").alias("dst"))


@query(f"""WITH {_LINKS}, h0 AS (SELECT src AS source, src AS node, 0 AS hop FROM (VALUES (1), (7)) v(src)), h1 AS (SELECT * FROM h0 UNION ALL SELECT source, dst, 1 FROM h0 JOIN b ON node = src),
h2 AS (SELECT source, node, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT source, dst, 2 FROM h1 JOIN b ON node = src WHERE hop = 1) GROUP BY source, node)
SELECT CAST(source AS BIGINT) AS source, CAST(node AS BIGINT) AS node, hop FROM h2""")
def hops(spark, d):
    return som.hops(_links(spark, d), spark.createDataFrame([(1,), (7,)], "node long"), 2).select("source", F.col("node").cast("long").alias("node"), "hop")


@query(f"""WITH {_LINKS}, n AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier), a AS (SELECT id AS source, x / 2 AS px, y * 2 AS py FROM n WHERE id <= 3),
h AS (SELECT source, node, min(hop) AS hop FROM (SELECT source, source AS node, 0 AS hop FROM a UNION ALL SELECT source, dst, 1 FROM a JOIN b ON src = source) GROUP BY 1, 2),
k AS (SELECT node AS id, px, py, exp(-(hop * hop) / (1.5 * 1.5)) * 0.2 AS k FROM h JOIN a USING (source)), t AS (SELECT id, sum(k) AS k, sum(k * px) AS kx, sum(k * py) AS ky FROM k GROUP BY id)
SELECT n.id, round({_PULL.format('x')}, 6) AS x, round({_PULL.format('y')}, 6) AS y FROM n LEFT JOIN t USING (id)""")
def graph_trigger(spark, d):
    net = s2(spark, d)
    pull = net.where("id <= 3").select(F.col("id").alias("node"), (F.col("x") / 2).alias("px"), (F.col("y") * 2).alias("py"))
    return som.graph_trigger(net, _links(spark, d), pull, 0.2, 1.5, 1).select("id", r6("x", "x"), r6("y", "y"))


@query("SELECT l_linenumber AS step, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(coalesce(stddev_pop(l_extendedprice), 0), 4) AS deviation FROM lineitem GROUP BY 1")
def step_statistics(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("step"), "l_extendedprice")
    return som.step_statistics(x, "step", "l_extendedprice").select("step", "n", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


# --- Grids ------------------------------------------------------------------------------------------------


def _mirrored(reach: int) -> str:
    return f"o AS (SELECT di, dj FROM range(-{reach}, {reach + 1}) a(di), range(-{reach}, {reach + 1}) b(dj)), m AS (SELECT g.i, g.j, g.v, g.c, o.di, o.dj, CASE WHEN g.i + di < 0 THEN -(g.i + di) WHEN g.i + di >= {WIDE} THEN {2 * WIDE - 2} - g.i - di ELSE g.i + di END AS ni, CASE WHEN g.j + dj < 0 THEN -(g.j + dj) WHEN g.j + dj >= h THEN 2 * h - 2 - g.j - dj ELSE g.j + dj END AS nj FROM g, s, o), n AS (SELECT m.*, b.v AS nv, b.c AS nc FROM m JOIN g b ON b.i = m.ni AND b.j = m.nj)"


@query(f"WITH {G} SELECT a.i, a.j, round(sum(abs(b.v - a.v)), 6) AS edge FROM g a JOIN g b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY a.i, a.j")
def grid_edge4(spark, d):
    return win.edge4(grid(spark, d)[0]).select("i", "j", r6("edge", "edge"))


@query(f"WITH {G}, {_mirrored(1)}, t AS (SELECT i, j, sum(nv * di * (2 - abs(dj))) AS gi, sum(nv * dj * (2 - abs(di))) AS gj FROM n GROUP BY i, j) SELECT i, j, round(sqrt(gi * gi + gj * gj), 6) AS sobel FROM t")
def grid_sobel(spark, d):
    x, size = grid(spark, d)
    return win.sobel(x, size).select("i", "j", r6("sobel", "sobel"))


@query(f"WITH {G}, {_mirrored(2)}, t AS (SELECT i, j, v, median(nv) AS m FROM n GROUP BY i, j, v) SELECT i, j, round(CASE WHEN v > 25 THEN m ELSE v END, 6) AS v FROM t")
def grid_median(spark, d):
    x, size = grid(spark, d)
    return win.median_filter(x, 2, size, F.col("v") > 25).select("i", "j", r6("v", "v"))


@query(f"""WITH {G}, {_mirrored(2)}, w AS (SELECT *, exp(-((di * di + dj * dj) / (18.0 * 18.0) + (nc - c) * (nc - c) / (100.0 * 100.0))) AS w FROM n),
r AS (SELECT *, sum(w) OVER (PARTITION BY i, j ORDER BY nv, di, dj) AS run, sum(w) OVER (PARTITION BY i, j) / 2 AS half FROM w) SELECT i, j, min(nv) AS v FROM r WHERE run >= half GROUP BY i, j""")
def grid_weighted_median(spark, d):
    x, size = grid(spark, d)
    return win.weighted_median_filter(x, 2, size, 18.0, 100.0)


_PAIR = "l AS (SELECT i, j, CAST(CAST(v AS BIGINT) % 8 AS DOUBLE) AS v FROM g), q AS (SELECT i, j, CAST(CAST(c AS BIGINT) % 8 AS DOUBLE) AS v FROM g), k AS (SELECT l.i, l.j, l.v, (q.v IS NULL OR abs(l.v - q.v) > 2) AS occluded FROM l LEFT JOIN q ON q.i = l.i - CAST(floor(l.v + 0.5) AS BIGINT) AND q.j = l.j)"


def _checked(spark, d) -> DataFrame:
    x, _ = grid(spark, d)
    eight = lambda c: (F.col(c).cast("long") % 8).cast("double").alias("v")
    price = (F.floor(F.col("c") + 0.5) % 8).cast("double").alias("v")
    return win.cross_check(x.select("i", "j", eight("v")), x.select("i", "j", price), 2)


@query(f"WITH {G}, {_PAIR.replace('CAST(c AS BIGINT)', 'CAST(floor(c + 0.5) AS BIGINT)')} SELECT i, j, v, occluded FROM k")
def cross_check(spark, d):
    return _checked(spark, d)


@query(f"""WITH {G}, {_PAIR.replace('CAST(c AS BIGINT)', 'CAST(floor(c + 0.5) AS BIGINT)')}, f AS (SELECT a.i, a.j, b.v, row_number() OVER (PARTITION BY a.i, a.j ORDER BY greatest(abs(a.i - b.i), abs(a.j - b.j)), b.v) AS r FROM k a JOIN k b ON a.occluded AND NOT b.occluded AND abs(a.i - b.i) <= 10 AND abs(a.j - b.j) <= 10)
SELECT k.i, k.j, coalesce(f.v, k.v) AS v FROM k LEFT JOIN f ON k.i = f.i AND k.j = f.j AND f.r = 1""")
def fill_occluded(spark, d):
    return win.fill_occluded(stored(_checked(spark, d), "checked"), 10)


@query(f"WITH {G}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM g) SELECT i, j, (v - lo) / (hi - lo) >= 0.5 AS active, CAST(floor((v - lo) / (hi - lo) * 255 + 0.5) AS BIGINT) AS density FROM g, b")
def edge_density(spark, d):
    return win.edge_density(grid(spark, d)[0], 0.5)


@query(f"""WITH {G}, {S2}, q AS (SELECT id, greatest(0.0, least(abs(x) / 300, {WIDE - 1}.0)) AS x, greatest(0.0, least(y / 7, CAST(h - 1 AS DOUBLE))) AS y FROM p, s),
c AS (SELECT id, unnest([0, 0, 1, 1]) AS di, unnest([0, 1, 0, 1]) AS dj, x - floor(x) AS fx, y - floor(y) AS fy, floor(x) AS ux, floor(y) AS uy FROM q)
SELECT c.id, round(sum((CASE WHEN di = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN dj = 1 THEN fy ELSE 1 - fy END) * g.v), 6) AS v FROM c, s, g WHERE g.i = least(ux + di, {WIDE - 1}) AND g.j = least(uy + dj, h - 1) GROUP BY c.id""")
def bilinear_fetch(spark, d):
    x, size = grid(spark, d)
    at = s2(spark, d).select("id", (F.abs("x") / 300).alias("x"), (F.col("y") / 7).alias("y"))
    return win.bilinear(x, at, size).select("id", r6("v", "v"))


_RGB = "k AS (SELECT p_partkey AS id, [CAST(p_size * 5 AS DOUBLE), CAST(p_partkey % 256 AS DOUBLE), CAST(p_size * p_partkey % 256 AS DOUBLE)] AS rgb FROM part), l AS (SELECT id, list_transform(rgb, lambda v: CASE WHEN v / 255 <= 0.04045 THEN v / 255 / 12.92 ELSE pow((v / 255 + 0.055) / 1.055, 2.4) END) AS t FROM k), xyz AS (SELECT id, " + ", ".join(f"t[1] * {a!r} + t[2] * {b!r} + t[3] * {c!r} AS {n}" for (a, b, c), n in zip(g.SRGB_XYZ, "xyz")) + " FROM l)"


def _rgb(spark, d) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(k.alias("id"), (s * 5).cast("double").alias("r"), (k % 256).cast("double").alias("g"), (s * k % 256).cast("double").alias("b"))


@query(f"WITH {_RGB} SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM xyz")
def rgb_to_xyz(spark, d):
    return _rgb(spark, d).select("id", *[r6(v, n) for v, n in zip(g.rgb_to_xyz("r", "g", "b"), XYZ)])


@query(f"WITH {_RGB}, f AS (SELECT id, " + ", ".join(f"CASE WHEN {n} / {w!r} > 0.008856 THEN pow({n} / {w!r}, {1 / 3!r}) ELSE ({n} / {w!r} * 903.3 + 16) / 116 END AS {n}" for n, w in zip("xyz", g.WHITE_D65)) + " FROM xyz) SELECT id, round(y * 116 - 16, 5) AS l, round((x - y) * 500, 5) AS a, round((y - z) * 200, 5) AS b FROM f")
def rgb_to_lab(spark, d):
    return _rgb(spark, d).select("id", *[F.round(v, 5).alias(n) for v, n in zip(g.rgb_to_lab("r", "g", "b"), "lab")])


@query(f"WITH {G} SELECT id, round((i - 20.0) * 160.0 / v, 6) AS x, round(-(j - 20.0) * 160.0 / v, 6) AS y, round(-(3740.0 * 160.0) / v, 6) AS z FROM g")
def disparity_to_3d(spark, d):
    x, _ = grid(spark, d)
    return x.select("id", *[r6(v, n) for v, n in zip(g.disparity_to_point("i", "j", "v", F.lit(40.0), 3740.0, 160.0), XYZ)])


@query(f"WITH {G} SELECT a.i, a.j, round(a.v + b.v, 6) AS total, round(a.v - b.v, 6) AS difference, round(a.v * b.v, 6) AS product, round(a.v * 2.5, 6) AS scaled FROM g a JOIN g b ON b.i = (a.i + 1) % {WIDE} AND b.j = a.j")
def grid_algebra(spark, d):
    x, _ = grid(spark, d)
    other = x.select(((F.col("i") + WIDE - 1) % WIDE).alias("i"), "j", F.col("v").alias("w"))
    v, w = F.col("v"), F.col("w")
    return x.join(other, ["i", "j"]).select("i", "j", r6(v + w, "total"), r6(v - w, "difference"), r6(v * w, "product"), r6(v * 2.5, "scaled"))


# --- Objectives ---------------------------------------------------------------------------------------------


@query(f"WITH {G} SELECT a.i, a.j, round(coalesce(sum(sqrt((b.c / 10 - a.c / 10) * (b.c / 10 - a.c / 10) + (b.v - a.v) * (b.v - a.v))), 0), 6) AS length FROM g a LEFT JOIN g b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1) GROUP BY a.i, a.j")
def length_term(spark, d):
    x, _ = grid(spark, d)
    return win.length_term(x.select("i", "j", (F.col("c") / 10).alias("x"), F.col("v").alias("y"))).select("i", "j", r6("length", "length"))


@query(f"WITH {G} SELECT a.i, a.j, round(sum(sqrt((b.v - a.v) * (b.v - a.v) + (b.c / 100 - a.c / 100) * (b.c / 100 - a.c / 100))), 6) AS smooth FROM g a JOIN g b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY a.i, a.j")
def smooth_term(spark, d):
    x, _ = grid(spark, d)
    return win.smooth_term(x.select("i", "j", F.col("v").alias("u"), (F.col("c") / 100).alias("v"))).select("i", "j", r6("smooth", "smooth"))


_COST = f"{G}, t AS (SELECT a.i, a.j, least(abs(a.v - b.v), 30.0) * 0.5 + least(abs(a.c / 100 - b.c / 100), 10.0) * 0.5 AS cost, h FROM g a, g b, s WHERE b.i = greatest(0, least(CAST(floor(a.i + CAST(a.v AS BIGINT) % 5 + 0.5) AS BIGINT), {WIDE - 1})) AND b.j = a.j)"


def _cost(spark, d) -> tuple[DataFrame, tuple[int, int]]:
    x, size = grid(spark, d)
    net = x.select("i", "j", "v", (F.col("c") / 100).alias("g"), (F.col("v").cast("long") % 5).alias("u"))
    return win.data_term(net, net, size), size


@query(f"WITH {_COST} SELECT i, j, round(cost, 6) AS cost FROM t")
def data_term(spark, d):
    return _cost(spark, d)[0].select("i", "j", r6("cost", "cost"))


@query(f"""WITH {_COST}, o AS (SELECT di, dj FROM range(-1, 2) a(di), range(-1, 2) b(dj)), m AS (SELECT i, j, CASE WHEN i + di < 0 THEN -(i + di) WHEN i + di >= {WIDE} THEN {2 * WIDE - 2} - i - di ELSE i + di END AS ni, CASE WHEN j + dj < 0 THEN -(j + dj) WHEN j + dj >= h THEN 2 * h - 2 - j - dj ELSE j + dj END AS nj FROM t, o)
SELECT m.i, m.j, round(sum(t.cost), 5) AS cost FROM m JOIN t ON t.i = m.ni AND t.j = m.nj GROUP BY m.i, m.j""")
def window_term(spark, d):
    cost, size = _cost(spark, d)
    return win.window_term(cost, 1, size).select("i", "j", F.round("cost", 5).alias("cost"))


@query("SELECT round(sum(o_totalprice), 2) AS price, CAST(sum(o_custkey) AS BIGINT) AS customers, round(sum(o_totalprice) * 0.25 + sum(o_custkey) * 2.0, 2) AS objective FROM orders")
def weighted_objective(spark, d):
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customers"))
    return win.objective(o, {"price": 0.25, "customers": 2.0}).select(F.round("price", 2).alias("price"), "customers", F.round("objective", 2).alias("objective"))


@query(f"WITH {G} SELECT i // 8 AS ci, j // 8 AS cj, round(sum(v * 1.0 + c * 0.5), 4) AS objective FROM g GROUP BY 1, 2")
def cell_objective(spark, d):
    return win.cell_objective(grid(spark, d)[0], 8, {"v": 1.0, "c": 0.5}).select("ci", "cj", F.round("objective", 4).alias("objective"))


def _motion(spark, d) -> DataFrame:
    return grid(spark, d)[0].select("i", "j", (F.col("v").cast("long") % 7).cast("double").alias("u"), (F.col("c") / 100).alias("v"))


_PRIOR = f"{G}, m AS (SELECT i, j, CAST(CAST(v AS BIGINT) % 7 AS DOUBLE) AS u, c / 100 AS v FROM g), d AS (SELECT a.i, a.j, sqrt((b.u - a.u) * (b.u - a.u) + (b.v - a.v) * (b.v - a.v)) AS d, b.u IS NOT NULL AS has FROM m a LEFT JOIN m b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1))"


@query(f"""WITH {_PRIOR} SELECT i, j, round(coalesce(sum(CASE WHEN has THEN least(d * d, 9.0) END), 0), 6) AS pstq, round(coalesce(sum(CASE WHEN has THEN least(d, 3.0) END), 0), 6) AS pstl,
round(coalesce(sum(CAST(has AND d <> 0 AS DOUBLE)), 0), 6) AS pcp, round(coalesce(sum(d), 0), 6) AS esl FROM d GROUP BY i, j""")
def smoothness_priors(spark, d):
    net, out = _motion(spark, d), None
    for k in win.PRIORS:
        now = win.prior_term(net, k, 3.0).select("i", "j", r6("smooth", k))
        out = now if out is None else out.join(now, ["i", "j"])
    return out


@query(f"""WITH {G}, l AS (SELECT a.i, a.j, coalesce(sum(sqrt((b.c / 10 - a.c / 10) * (b.c / 10 - a.c / 10) + (b.v - a.v) * (b.v - a.v))), 0) AS one, coalesce(sum(sqrt((b.v - a.v) * (b.v - a.v) * 2)), 0) AS two FROM g a LEFT JOIN g b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1) GROUP BY a.i, a.j) SELECT i, j, round(abs(one - two), 6) AS smooth FROM l""")
def length_difference(spark, d):
    x, _ = grid(spark, d)
    return win.length_difference(x.select("i", "j", (F.col("c") / 10).alias("x"), F.col("v").alias("y")), x.select("i", "j", F.col("v").alias("x"), F.col("v").alias("y"))).select("i", "j", r6("smooth", "smooth"))


@query(f"WITH {G} SELECT i, j, round(sqrt((CAST(v AS BIGINT) % 7 - 3.0) * (CAST(v AS BIGINT) % 7 - 3.0) + (c / 100 - v / 5) * (c / 100 - v / 5)), 6) AS error FROM g")
def motion_error(spark, d):
    truth = grid(spark, d)[0].select("i", "j", F.lit(3.0).alias("u"), (F.col("v") / 5).alias("v"))
    return win.motion_error(_motion(spark, d), truth).select("i", "j", r6("error", "error"))


# --- Search over nodes and populations -------------------------------------------------------------------


@query(f"""WITH {G}, k AS (SELECT a.i, a.j, t.v, abs(a.v - b.v) AS cost FROM g a, range(0, 9) t(v), g b WHERE t.v <= a.i AND b.i = a.i - t.v AND b.j = a.j),
r AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY cost, v) AS r FROM k) SELECT i, j, v, cost FROM r WHERE r = 1""")
def stereo_winner(spark, d):
    x, _ = grid(spark, d)
    right = x.select(F.col("i").alias("_i"), "j", F.col("v").alias("_v"))
    options = search.stereo_candidates(x, 8).join(x.select("i", "j", F.col("v").alias("own")), ["i", "j"])
    options = options.withColumn("_i", F.col("i") - F.col("v")).join(right, ["_i", "j"]).select("i", "j", F.col("v").cast("long").alias("v"), F.abs(F.col("own") - F.col("_v")).alias("cost"))
    return search.winner_takes_all(options, ["i", "j"])


@query()
def local_search(spark, d):
    x, _ = grid(spark, d)
    data = x.select("i", "j", F.col("v").alias("own"))
    propose = lambda field, k: search.propagated_candidates(field) if k < 2 else search.random_candidates(field, 2.0, k)
    cost = lambda rows: rows.join(data, ["i", "j"]).select("i", "j", "v", F.abs(F.col("v") - F.col("own")).alias("cost"))
    return search.local_search(x.select("i", "j", F.lit(0.0).alias("v")), propose, cost, 4)


@query(f"WITH {G} SELECT i, j, step, i + step * 0.5 AS x, j - step * 0.5 AS y FROM g, range(0, 4) s(step)")
def line_candidates(spark, d):
    x, _ = grid(spark, d)
    net = x.select("i", "j", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"))
    return search.line_candidates(net, (1, -1), 3, 2.0).select("i", "j", F.col("step").cast("long").alias("step"), "x", "y")


def _absolute(x: DataFrame):
    """A cost of (i, j, v) rows: how far v is from a tenth of the price."""
    data = x.select("i", "j", (F.col("c") / 100).alias("_own"))
    return lambda rows: rows.join(data, ["i", "j"]).select("i", "j", "v", F.abs(F.col("v") - F.col("_own")).alias("cost"))


@query(f"""WITH {G}, m AS (SELECT i, j, v, i // 8 * 1000 + j // 8 AS grp, ((i // 8 + j // 8) % 5 - 2) * 3.0 AS delta, abs(v - c / 100) AS b, abs(v + ((i // 8 + j // 8) % 5 - 2) * 3.0 - c / 100) AS a FROM g),
k AS (SELECT grp, sum(a) < sum(b) AS better FROM m GROUP BY grp) SELECT i, j, CASE WHEN better THEN v + delta ELSE v END AS v FROM m JOIN k USING (grp)""")
def large_moves(spark, d):
    x, _ = grid(spark, d)
    ci, cj = F.floor(F.col("i") / 8), F.floor(F.col("j") / 8)
    # From 1000 cells on along j several cells have one number: they are one group, whose nodes keep the deltas of their cells.
    members = x.select((ci * 1000 + cj).alias("group"), "i", "j", (((ci + cj) % 5 - 2) * 3.0).alias("delta"))
    return search.joint_moves(x.select("i", "j", "v"), members, None, _absolute(x))


@query(f"""WITH {G}, c AS (SELECT id AS grp, i, j FROM g WHERE i % 3 = 1 AND j % 3 = 1), o AS (SELECT di, dj FROM range(-1, 2) a(di), range(-1, 2) b(dj)), w AS (SELECT i + di AS i, j + dj AS j, min(grp) AS grp FROM c, o GROUP BY 1, 2),
m AS (SELECT g.i, g.j, w.grp, abs(v - c / 100) AS b, abs(v - 4.0 - c / 100) AS a FROM g JOIN w ON g.i = w.i AND g.j = w.j), k AS (SELECT grp FROM m GROUP BY grp HAVING sum(a) < sum(b)), n AS (SELECT i, j FROM m JOIN k USING (grp))
SELECT g.i, g.j, CASE WHEN n.i IS NULL THEN v ELSE v - 4.0 END AS v FROM g LEFT JOIN n ON g.i = n.i AND g.j = n.j""")
def window_moves(spark, d):
    x, _ = grid(spark, d)
    members = search.windows_of(x.where("i % 3 = 1 AND j % 3 = 1").select(F.col("id").alias("group"), "i", "j"), 1)
    return search.joint_moves(x.select("i", "j", "v"), members, members.select("group", F.lit(-4.0).alias("delta")).distinct(), _absolute(x))


@query(f"""WITH {G}, m AS (SELECT i, j, v, i // 8 * 1000 + j // 8 AS grp, {_U.format('id', 5)} < 0.4 AS moves, abs(v - c / 100) AS b, abs(v - 6.0 - c / 100) AS a FROM g),
k AS (SELECT grp FROM m WHERE moves GROUP BY grp HAVING sum(a) < sum(b)) SELECT i, j, CASE WHEN moves AND k.grp IS NOT NULL THEN v - 6.0 ELSE v END AS v FROM m LEFT JOIN k USING (grp)""")
def random_moves(spark, d):
    x, _ = grid(spark, d)
    members = search.random_pick(x, F.floor(F.col("i") / 8) * 1000 + F.floor(F.col("j") / 8), 0.4, g.linear_uniform("id", 5))
    return search.joint_moves(x.select("i", "j", "v"), members, members.select("group", F.lit(-6.0).alias("delta")).distinct(), _absolute(x))


@query(f"WITH {G}, e AS (SELECT i, j, c, CASE WHEN abs(9.0 - c / 100) < abs(v - c / 100) OR (abs(9.0 - c / 100) = abs(v - c / 100) AND 9.0 < v) THEN 9.0 ELSE v END AS v FROM g) SELECT i, j, CASE WHEN v IN (9.0, 12.0) AND (abs(21.0 - v - c / 100) < abs(v - c / 100) OR (abs(21.0 - v - c / 100) = abs(v - c / 100) AND 21.0 - v < v)) THEN 21.0 - v ELSE v END AS v FROM e")
def expansion_and_swap(spark, d):
    x, _ = grid(spark, d)
    return search.swap(search.expansion(x.select("i", "j", "v"), 9.0, _absolute(x)), 9.0, 12.0, _absolute(x))


@query(f"WITH {G} SELECT i, j, CASE WHEN abs(8.0 - c / 100) < abs(v - c / 100) OR (abs(8.0 - c / 100) = abs(v - c / 100) AND 8.0 < v) THEN 8.0 ELSE v END AS v FROM g")
def variable_descent(spark, d):
    """Two kinds of proposals: one that never helps, then a value that helps some nodes."""
    x, _ = grid(spark, d)
    kinds = [lambda f, k: f.select("i", "j", F.lit(1e6).alias("v")), lambda f, k: f.select("i", "j", F.lit(8.0).alias("v"))]
    return search.variable_descent(x.select("i", "j", "v"), kinds, _absolute(x))


@query(f"""WITH p AS (SELECT s_suppkey AS agent, s_acctbal AS cost, [CAST(s_nationkey AS DOUBLE), s_acctbal, CAST(s_suppkey AS DOUBLE)] AS state, {_U.format('s_suppkey', 3)} AS u, {_U.format('s_suppkey', 4)} AS v FROM supplier),
r AS (SELECT *, row_number() OVER (ORDER BY cost, agent) AS up, row_number() OVER (ORDER BY cost DESC, agent DESC) AS down FROM p),
c AS (SELECT w.agent, coalesce(b.agent, w.agent) AS source, w.state AS own, b.state AS other, CAST(floor(w.u * 4) AS INT) AS cut, CAST(floor(w.v * 3) AS INT) AS gene, ((w.v * 3 - floor(w.v * 3)) * 2 - 1) * 2.5 AS shift FROM r w LEFT JOIN r b ON w.down = b.up AND w.down <= 4),
k AS (SELECT agent, source, CASE WHEN source = agent THEN own ELSE [CASE WHEN 0 < cut THEN other[1] ELSE own[1] END + CASE WHEN gene = 0 THEN shift ELSE 0 END, CASE WHEN 1 < cut THEN other[2] ELSE own[2] END + CASE WHEN gene = 1 THEN shift ELSE 0 END, CASE WHEN 2 < cut THEN other[3] ELSE own[3] END + CASE WHEN gene = 2 THEN shift ELSE 0 END] END AS s FROM c)
SELECT agent, source, round(s[1], 6) AS a, round(s[2], 6) AS b, round(s[3], 6) AS c FROM k""")
def ga_generation(spark, d):
    s = table(spark, d, "supplier")
    p = s.select(F.col("s_suppkey").alias("agent"), F.col("s_acctbal").alias("cost"), F.array(F.col("s_nationkey").cast("double"), "s_acctbal", F.col("s_suppkey").cast("double")).alias("state"))
    out = search.generation(p, 4, 2.5, g.linear_uniform("agent", 3), g.linear_uniform("agent", 4))
    return out.select("agent", "source", *[F.round(F.col("state")[k], 6).alias(n) for k, n in enumerate("abc")])


_POP = "p AS (SELECT s_suppkey AS agent, s_acctbal AS cost FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY cost, agent) AS up, row_number() OVER (ORDER BY cost DESC, agent DESC) AS down FROM p)"


def _population(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("agent"), F.col("s_acctbal").alias("cost"))


@query(f"WITH {_POP} SELECT w.agent, CASE WHEN w.down <= 4 THEN b.agent ELSE w.agent END AS source, CASE WHEN w.down <= 4 THEN b.cost ELSE w.cost END AS cost FROM r w LEFT JOIN r b ON w.down = b.up")
def ga_select(spark, d):
    return search.select(_population(spark, d), 4)


@query(f"WITH {_POP} SELECT agent, CASE WHEN down <= 3 THEN -1 ELSE agent END AS source, CASE WHEN down <= 3 THEN -5000.0 ELSE cost END AS cost FROM r")
def ga_elite(spark, d):
    best = spark.range(1).select(F.lit(-1).cast("long").alias("agent"), F.lit(-5000.0).alias("cost"))
    return search.select_elite(_population(spark, d), best, 3)


@query(f"WITH {_POP} SELECT b.agent AS best, b.cost AS best_cost, w.agent AS worst, w.cost AS worst_cost FROM r b, r w WHERE b.up = 1 AND w.down = 1")
def best_and_worst(spark, d):
    return search.best_and_worst(_population(spark, d))


@query()
def evolve(spark, d):
    aim = np.array([1.0, -2.0, 3.0])
    return search.evolve(spark, 16, 4, 4, lambda r: r.normal(0, 5, 3), lambda s, r: s + r.normal(0, 0.5, len(s)), lambda s: float(((s - aim) ** 2).sum()), 11)


# --- Planar geometry ---------------------------------------------------------------------------------------

_QUAD = "q AS (SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS a, s_acctbal / 100 AS b FROM supplier), r AS (SELECT id, [0.0, a + 1, a + 2, 0.5] AS xs, [0.0, 0.25, b, b + 1] AS ys, a, b FROM q), e AS (SELECT id, xs, ys, a, b, unnest([1, 2, 3, 4]) AS k, unnest([2, 3, 4, 1]) AS m FROM r)"


def _quads(spark, d) -> DataFrame:
    a, b = F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 100
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), a.alias("a"), b.alias("b"), F.array(p(F.lit(0.0), F.lit(0.0)), p(a + 1, F.lit(0.25)), p(a + 2, b), p(F.lit(0.5), b + 1)).alias("ring"))


_AREA = "sum(xs[k] * ys[m] - xs[m] * ys[k]) / 2"


@query(f"WITH {_QUAD} SELECT id, round(abs({_AREA}), 6) AS area, {_AREA} < 0 AS clockwise, round(sum(xs[k]) / 4, 6) AS bx, round(sum(ys[k]) / 4, 6) AS by, round(sum(sqrt((xs[k] - xs[m]) * (xs[k] - xs[m]) + (ys[k] - ys[m]) * (ys[k] - ys[m]))), 6) AS length FROM e GROUP BY id")
def polygon_measures(spark, d):
    c = g.barycentre("ring")
    return _quads(spark, d).select("id", r6(g.ring_area("ring"), "area"), g.is_clockwise("ring").alias("clockwise"), r6(c["x"], "bx"), r6(c["y"], "by"), r6(g.ring_length("ring"), "length"))


@query(f"WITH {_QUAD} SELECT id, round(list_min(xs), 6) AS x1, round(list_min(ys), 6) AS y1, round(list_max(xs), 6) AS x2, round(list_max(ys), 6) AS y2 FROM r")
def polygon_bbox(spark, d):
    b = g.bounding_box("ring")
    return _quads(spark, d).select("id", *[r6(b[k], k) for k in ("x1", "y1", "x2", "y2")])


@query(f"WITH {_QUAD} SELECT id, sum(CAST((ys[k] > 2.0) <> (ys[m] > 2.0) AND 1.0 < (xs[m] - xs[k]) * (2.0 - ys[k]) / (ys[m] - ys[k]) + xs[k] AS INT)) % 2 = 1 AS inside FROM e GROUP BY id")
def polygon_contains(spark, d):
    return _quads(spark, d).select("id", g.contains_point("ring", F.lit(1.0), F.lit(2.0)).alias("inside"))


@query("""WITH q AS (SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS a, s_acctbal / 100 AS b FROM supplier), t AS (SELECT id, (0.0 - (a + 1)) * (1.0 - b) - (0.0 - 2.0) * (0.0 - 3.0) AS det, 0.0 * 2.0 - 0.0 * (a + 1) AS u, 0.0 * b - 1.0 * 3.0 AS v, a, b FROM q)
SELECT id, round((u * (0.0 - 3.0) - (0.0 - (a + 1)) * v) / det, 6) AS x, round((u * (1.0 - b) - (0.0 - 2.0) * v) / det, 6) AS y FROM t WHERE det <> 0""")
def line_intersect(spark, d):
    zero = F.lit(0.0)
    p = g.line_intersection((zero, zero), (F.col("a") + 1, F.lit(2.0)), (zero, F.lit(1.0)), (F.lit(3.0), F.col("b")))
    return _quads(spark, d).select("id", p.alias("p")).where("p IS NOT NULL").select("id", r6("p.x", "x"), r6("p.y", "y"))


@query("""WITH q AS (SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS r FROM supplier), h AS (SELECT id, r, (4.0 - 1.0 * 1.0 - 2.0 * 0.5) / 5.0 AS off FROM q), w AS (SELECT id, 1.0 + 1.0 * off AS fx, 0.5 + 2.0 * off AS fy, r * r - off * off * 5.0 AS rest FROM h)
SELECT id, round(fx + s * 2.0 * sqrt(rest / 5.0), 6) AS x, round(fy - s * 1.0 * sqrt(rest / 5.0), 6) AS y FROM w, (VALUES (-1.0), (1.0)) v(s) WHERE rest > 0""")
def circle_line(spark, d):
    hits = g.circle_line(F.lit(1.0), F.lit(0.5), "a", F.lit(1.0), F.lit(2.0), F.lit(4.0))
    return _quads(spark, d).select("id", F.explode(hits).alias("p")).select("id", r6("p.x", "x"), r6("p.y", "y"))


@query("SELECT s_suppkey AS id, round(atan2(1.0 * (s_acctbal / 100) - 2.0 * s_nationkey, 1.0 * s_nationkey + 2.0 * (s_acctbal / 100)), 6) AS angle FROM supplier")
def angles(spark, d):
    return _quads(spark, d).select("id", r6(g.angle_between(F.lit(1.0), F.lit(2.0), "a", "b"), "angle"))


@query("SELECT di AS i, dj AS j, CAST(greatest(abs(di), abs(dj)) AS BIGINT) AS quad, CAST(abs(di) + abs(dj) AS BIGINT) AS tetra, CAST(greatest(abs(di), abs(dj), abs(di + dj)) AS BIGINT) AS hexa FROM range(-3, 4) a(di), range(-3, 4) b(dj)")
def neighbourhood_rings(spark, d):
    rows = [(i, j) for _, i, j in win.ring_offsets("quad", 3)]
    of = {t: {(i, j): r for r, i, j in win.ring_offsets(t, 9)} for t in ("quad", "tetra", "hexa")}
    return spark.createDataFrame([(i, j, *[of[t][i, j] for t in of]) for i, j in rows], "i long, j long, quad long, tetra long, hexa long")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, CAST(floor((value - 0.0 + 50.0 / 2) / 50.0) AS BIGINT) AS cvalue, count(*) AS n, round(sum(value), 4) AS sum_value FROM events GROUP BY 1, 2")
def windowed_cells(spark, d):
    x = windowed_density(table(spark, d, "events"), ["value"], 50.0)
    return x.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "cvalue", "n", F.round("sum_value", 4).alias("sum_value"))


@query("SELECT s_suppkey AS id, (s_nationkey * 2 + 5 % 2) * 3 - 5 * 3 + 17 AS low, s_nationkey * 3 - 5 * 3 + 17 AS base, CAST(s_nationkey * 2 + 5 % 2 AS BIGINT) AS dual, CAST(s_nationkey AS DOUBLE) AS euclid FROM supplier")
def grid_views(spark, d):
    n = F.col("s_nationkey")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), g.dual_to_low(n, 3, 5, 17).alias("low"), g.base_to_low(n, 3, 5, 17).alias("base"), g.dual_to_base(n, 5).cast("long").alias("dual"), g.to_euclid(n).alias("euclid"))


@query("""WITH q AS (SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS a, s_acctbal / 100 AS b FROM supplier),
s AS (SELECT id, unnest([0.0, 5.0]) AS px, unnest([0.0, 4.0]) AS py, unnest([5.0, 30.0]) AS qx, unnest([4.0, 0.0]) AS qy, a, b FROM q), t AS (SELECT *, a AS rx, -1.0 AS ry, a + 2 AS sx, b AS sy FROM s),
k AS (SELECT *, (qx - px) * (ry - py) - (qy - py) * (rx - px) AS t1, (qx - px) * (sy - py) - (qy - py) * (sx - px) AS t2, (sx - rx) * (py - ry) - (sy - ry) * (px - rx) AS t3, (sx - rx) * (qy - ry) - (sy - ry) * (qx - rx) AS t4, (px - qx) * (ry - sy) - (py - qy) * (rx - sx) AS det, px * qy - py * qx AS u, rx * sy - ry * sx AS v FROM t)
SELECT id, round((u * (rx - sx) - (px - qx) * v) / det, 6) AS x, round((u * (ry - sy) - (py - qy) * v) / det, 6) AS y FROM k WHERE t1 * t2 <= 0 AND t3 * t4 <= 0 AND NOT (t1 = 0 AND t2 = 0) AND det <> 0""")
def polyline_crossings(spark, d):
    p = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    one = F.array(p(0, 0), p(5, 4), p(30, 0))
    two = F.array(F.struct(F.col("a").alias("x"), F.lit(-1.0).alias("y")), F.struct((F.col("a") + 2).alias("x"), F.col("b").alias("y")))
    return _quads(spark, d).select("id", F.explode(g.polyline_crossings(one, two)).alias("p")).select("id", r6("p.x", "x"), r6("p.y", "y"))


@query("""WITH q AS (SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS a, s_acctbal / 100 AS b FROM supplier), s AS (SELECT id, a, 1.0 AS y1, CASE WHEN b > a THEN b WHEN a + 3 > a THEN a + 3 END AS x2, CASE WHEN b > a THEN 2.0 ELSE 3.0 END AS y2 FROM q)
SELECT id, round(a, 6) AS x1, round(x2, 6) AS x2, y2, round(CASE WHEN a + 3 > x2 THEN a + 3 ELSE x2 + 100 END, 6) AS x3, 3.0 AS y3 FROM s""")
def increasing_polyline(spark, d):
    p = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    line = g.increasing(F.array(p(F.col("a"), 1.0), p(F.col("b"), 2.0), p(F.col("a") + 3, 3.0)))
    return _quads(spark, d).select("id", line.alias("l")).select("id", r6(F.col("l")[0]["x"], "x1"), r6(F.col("l")[1]["x"], "x2"), F.col("l")[1]["y"].alias("y2"), r6(F.col("l")[2]["x"], "x3"), F.col("l")[2]["y"].alias("y3"))
