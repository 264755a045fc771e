"""Distances, cells, colour and planar geometry as Column expressions; all stay in generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import pi, sqrt

from pyspark.sql import Column, functions as F

Distance = Callable[[str, str], Column]
AXES = ("x", "y", "z")


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# --- Distances between the coordinates of two sides of a join, by column suffix -------------------


def squared(a: Sequence, b: Sequence) -> Column:
    """Squared Euclidean distance, summed in the order of the axes."""
    total = None
    for u, v in zip(a, b):
        d = c(u) - c(v)
        total = d * d if total is None else total + d * d
    return total


def euclidean(a: Sequence, b: Sequence) -> Column:
    return F.sqrt(squared(a, b))


def manhattan(a: Sequence, b: Sequence) -> Column:
    total = None
    for u, v in zip(a, b):
        d = F.abs(c(u) - c(v))
        total = d if total is None else total + d
    return total


def superpixel(a_xy: Sequence, b_xy: Sequence, a_rgb: Sequence, b_rgb: Sequence, colour_unit: float = 0.5, spatial_unit: float = 40.0) -> Column:
    """Colour distance over its unit plus spatial distance over its unit."""
    return euclidean(a_rgb, b_rgb) / colour_unit + euclidean(a_xy, b_xy) / spatial_unit


def weighted(terms: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum of weighted terms, as objectives and mixed distances use it."""
    total = None
    for t, w in zip(terms, weights):
        total = t * w if total is None else total + t * w
    return total


def dot(a: Sequence, b: Sequence) -> Column:
    total = None
    for u, v in zip(a, b):
        total = c(u) * c(v) if total is None else total + c(u) * c(v)
    return total


# --- Cells and grid views -------------------------------------------------------------------------


def half_up(x) -> Column:
    """floor(x + 1/2): the nearest integer, halves upwards."""
    return F.floor(c(x) + 0.5)


def quad_cell(p: Sequence, low: Sequence, side) -> list[Column]:
    """Cell of a point by axis; a cell is centred on a multiple of the side from ``low``."""
    return [F.floor((c(v) - c(a) + c(side) / 2) / c(side)).cast("long") for v, a in zip(p, low)]


def diamond_cell(x, y, side) -> list[Column]:
    """Cell of a lattice of diamonds: squares in axes turned by 45 degrees."""
    return [half_up((c(x) + c(y)) / c(side)).cast("long"), half_up((c(y) - c(x)) / c(side)).cast("long")]


def hexagon_cell(x, y, side) -> list[Column]:
    """Axial coordinates of the hexagon (circumradius ``side``, flat sides left and right) that holds a point: cube rounding."""
    q, r = (c(x) * sqrt(3) / 3 - c(y) / 3) / c(side), c(y) * 2 / 3 / c(side)
    s = -q - r
    a, b, d = half_up(q), half_up(r), half_up(s)
    da, db, dd = F.abs(a - q), F.abs(b - r), F.abs(d - s)
    return [F.when((da > db) & (da > dd), -b - d).otherwise(a).cast("long"), F.when((da > db) & (da > dd), b).when(db > dd, -a - d).otherwise(b).cast("long")]


def base_to_low(p, radius, centre, low_centre) -> Column:
    """Coordinate of a base lattice in the image below it."""
    return c(p) * c(radius) - c(centre) * c(radius) + c(low_centre)


def dual_to_base(p, centre) -> Column:
    return c(p) * 2 + c(centre) % 2


def mirror(i, n) -> Column:
    """Reflect an index at both borders of 0..n-1."""
    i, n = c(i), c(n)
    return F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)


def clamp(i, n) -> Column:
    return F.greatest(F.lit(0), F.least(c(i), c(n) - 1))


def lattice_side(n: float, extent: Sequence[float]) -> float:
    """Scale that gives about a unit cell to each of n points spread over an extent."""
    wide = [e if e > 0 else 1.0 for e in extent]
    if len(wide) == 2:
        return (-(-2 * (n * wide[0] / wide[1]) ** 0.5 // 1) + 1) / wide[0]
    return (-(-((n * wide[0] ** 2 / (wide[1] * wide[2])) ** 0.333) // 1) + 1) / wide[0]


def bell(distance, radius) -> Column:
    """exp(-d^2 / r^2): how much a neighbour at a distance follows."""
    return F.exp(-(c(distance) * c(distance)) / (c(radius) * c(radius)))


# --- Colour ---------------------------------------------------------------------------------------

# sRGB to XYZ under D65 by row, the white point, and the constants of CIELAB.
SRGB_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE_D65 = (0.950456, 1.0, 1.088754)
LAB_EPSILON, LAB_KAPPA = 0.008856, 903.3


def rgb_to_xyz(r, g, b) -> list[Column]:
    """sRGB of 0..255 to XYZ."""
    lin = [F.when(c(v) / 255 <= 0.04045, c(v) / 255 / 12.92).otherwise(F.pow((c(v) / 255 + 0.055) / 1.055, F.lit(2.4))) for v in (r, g, b)]
    return [lin[0] * row[0] + lin[1] * row[1] + lin[2] * row[2] for row in SRGB_XYZ]


def rgb_to_lab(r, g, b) -> list[Column]:
    f = [F.when(v / w > LAB_EPSILON, F.pow(v / w, F.lit(1 / 3))).otherwise((v / w * LAB_KAPPA + 16) / 116) for v, w in zip(rgb_to_xyz(r, g, b), WHITE_D65)]
    return [f[1] * 116 - 16, (f[0] - f[1]) * 500, (f[1] - f[2]) * 200]


def disparity_to_point(i, j, disparity, width, focal: float, base: float) -> list[Column]:
    """3-D point of a pixel with a disparity; both image axes are centred by the width."""
    d = c(disparity)
    return [(c(i) - c(width) / 2) * base / d, -(c(j) - c(width) / 2) * base / d, -(F.lit(focal) * base) / d]


# --- Segments, lines, circles ---------------------------------------------------------------------


def turn(ax, ay, bx, by, px, py) -> Column:
    """Twice the signed area of a, b, p: above 0 if p is left of a->b."""
    return (c(bx) - c(ax)) * (c(py) - c(ay)) - (c(by) - c(ay)) * (c(px) - c(ax))


def same_side(ax, ay, bx, by, px, py, qx, qy) -> Column:
    return turn(ax, ay, bx, by, px, py) * turn(ax, ay, bx, by, qx, qy) >= 0


def line_intersection(p: Sequence, q: Sequence, r: Sequence, s: Sequence) -> Column:
    """Struct (x, y) where the lines pq and rs meet; null if they are parallel."""
    (px, py), (qx, qy), (rx, ry), (sx, sy) = ([c(v) for v in t] for t in (p, q, r, s))
    det = (px - qx) * (ry - sy) - (py - qy) * (rx - sx)
    a, b = px * qy - py * qx, rx * sy - ry * sx
    return F.when(det != 0, F.struct(((a * (rx - sx) - (px - qx) * b) / det).alias("x"), ((a * (ry - sy) - (py - qy) * b) / det).alias("y")))


def segments_cross(p: Sequence, q: Sequence, r: Sequence, s: Sequence) -> Column:
    """Whether the segments pq and rs have a point in common other than by touching in a line."""
    return (turn(*p, *q, *r) * turn(*p, *q, *s) <= 0) & (turn(*r, *s, *p) * turn(*r, *s, *q) <= 0) & ~((turn(*p, *q, *r) == 0) & (turn(*p, *q, *s) == 0))


def circle_line(cx, cy, radius, a, b, k) -> Column:
    """Array of 0, 1 or 2 structs (x, y) where the circle meets the line a x + b y = k."""
    cx, cy, radius, a, b, k = map(c, (cx, cy, radius, a, b, k))
    norm = a * a + b * b
    off = (k - a * cx - b * cy) / norm
    fx, fy = cx + a * off, cy + b * off
    left = radius * radius - off * off * norm
    h = F.sqrt(F.greatest(left, F.lit(0.0)) / norm)
    point = lambda sign: F.struct((fx + b * h * sign).alias("x"), (fy - a * h * sign).alias("y"))
    return F.when(left > 0, F.array(point(-1), point(1))).when(left == 0, F.array(point(1)))


def circle_circle(ax, ay, ar, bx, by, br) -> Column:
    """Where two circles meet: on the line of equal power."""
    ax, ay, ar, bx, by, br = map(c, (ax, ay, ar, bx, by, br))
    return circle_line(ax, ay, ar, 2 * (bx - ax), 2 * (by - ay), ar * ar - br * br - ax * ax - ay * ay + bx * bx + by * by)


def vertical_circle(at, cx, cy, radius) -> Column:
    return circle_line(cx, cy, radius, F.lit(1.0), F.lit(0.0), at)


def vertical_line(at, slope, shift) -> Column:
    return F.struct(c(at).alias("x"), (c(slope) * c(at) + c(shift)).alias("y"))


def angle_between(ux, uy, vx, vy) -> Column:
    """Signed angle from u to v in radians."""
    return F.atan2(c(ux) * c(vy) - c(uy) * c(vx), c(ux) * c(vx) + c(uy) * c(vy))


# --- Rings: arrays of structs (x, y), the last vertex joined to the first -------------------------


def _edges(ring) -> Column:
    ring = c(ring)
    return F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)).alias("q"))


def _sum(items: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def ring_signed_area(ring) -> Column:
    """Shoelace area, above 0 if the ring runs counter-clockwise."""
    return _sum(_edges(ring), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]) / 2


def ring_area(ring) -> Column:
    return F.abs(ring_signed_area(ring))


def is_clockwise(ring) -> Column:
    return ring_signed_area(ring) < 0


def reversed_ring(ring) -> Column:
    return F.reverse(c(ring))


def closed_ring(ring) -> Column:
    return F.concat(c(ring), F.slice(c(ring), 1, 1))


def barycentre(ring) -> Column:
    n = F.size(c(ring))
    return F.struct((_sum(c(ring), lambda p: p["x"]) / n).alias("x"), (_sum(c(ring), lambda p: p["y"]) / n).alias("y"))


def ring_length(ring) -> Column:
    return _sum(_edges(ring), lambda e: F.sqrt((e["p"]["x"] - e["q"]["x"]) * (e["p"]["x"] - e["q"]["x"]) + (e["p"]["y"] - e["q"]["y"]) * (e["p"]["y"] - e["q"]["y"])))


def bounding_box(ring) -> Column:
    xs, ys = F.transform(c(ring), lambda p: p["x"]), F.transform(c(ring), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def extreme_vertex(ring, axis: str, top: bool) -> Column:
    """The first vertex in order of the axis (then the other one), or the last."""
    other = "y" if axis == "x" else "x"
    order = F.array_sort(F.transform(c(ring), lambda p: F.struct(p[axis].alias(axis), p[other].alias(other))))
    return F.element_at(order, -1 if top else 1)


def contains_point(ring, x, y) -> Column:
    """Even-odd rule by a ray to the right."""
    x, y = c(x), c(y)
    hits = F.filter(_edges(ring), lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]))
    return F.size(hits) % 2 == 1


def contains_box(ring, x1, y1, x2, y2) -> Column:
    return contains_point(ring, x1, y1) & contains_point(ring, x1, y2) & contains_point(ring, x2, y1) & contains_point(ring, x2, y2)


def is_simple(ring) -> Column:
    """No two edges that aren't neighbours cross."""
    edges = F.transform(_edges(ring), lambda e, i: F.struct(i.alias("i"), e["p"].alias("p"), e["q"].alias("q")))
    n = F.size(c(ring))
    xy = lambda s: (s["x"], s["y"])
    cross = lambda e, f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1)) & segments_cross(xy(e["p"]), xy(e["q"]), xy(f["p"]), xy(f["q"]))
    return ~F.exists(edges, lambda e: F.exists(edges, lambda f: cross(e, f)))


def transformed(ring, a: float, b: float, d: float, e: float, dx: float = 0.0, dy: float = 0.0) -> Column:
    """Affine image of a ring: (a x + b y + dx, d x + e y + dy)."""
    return F.transform(c(ring), lambda p: F.struct((p["x"] * a + p["y"] * b + dx).alias("x"), (p["x"] * d + p["y"] * e + dy).alias("y")))


def flipped(ring, at) -> Column:
    """Mirror image about the vertical through ``at``."""
    return F.transform(c(ring), lambda p: F.struct((2 * c(at) - p["x"]).alias("x"), p["y"].alias("y")))


def parsed_ring(text) -> Column:
    """Ring of a text "x,y x,y ..."."""
    return F.transform(F.filter(F.split(F.trim(c(text)), r"\s+"), lambda t: t.contains(",")), lambda t: F.struct(F.split(t, ",")[0].cast("double").alias("x"), F.split(t, ",")[1].cast("double").alias("y")))


def repaired(ring) -> Column:
    """The ring without vertices equal to the one before or in line between their neighbours."""
    distinct = F.transform(F.filter(_edges(ring), lambda e: (e["p"]["x"] != e["q"]["x"]) | (e["p"]["y"] != e["q"]["y"])), lambda e: e["p"])
    n = F.size(distinct)
    with_index = F.transform(distinct, lambda p, i: F.struct(p.alias("p"), F.element_at(distinct, F.when(i == 0, n).otherwise(i)).alias("o"), F.element_at(distinct, F.when(i == n - 1, 1).otherwise((i + 2).cast("int"))).alias("q")))
    return F.transform(F.filter(with_index, lambda t: turn(t["o"]["x"], t["o"]["y"], t["q"]["x"], t["q"]["y"], t["p"]["x"], t["p"]["y"]) != 0), lambda t: t["p"])


# --- Views of a lattice, variates, polylines -----------------------------------------------------------


def dual_to_low(p, radius, centre, low_centre) -> Column:
    """Coordinate of a cell in the image two levels below it."""
    return base_to_low(dual_to_base(p, centre), radius, centre, low_centre)


def to_euclid(p) -> Column:
    return c(p).cast("double")


def linear_uniform(key, seed: int) -> Column:
    """A number in (0, 1) from a whole number: one step of a multiplicative generator modulo a prime, the same in any engine."""
    prime = 2147483647
    return (F.pmod(F.pmod(c(key).cast("long") + seed, F.lit(prime)) * 48271 + 11, F.lit(prime)) + 0.5) / float(prime)


def uniform_between(u, a, b) -> Column:
    return c(a) + c(u) * (c(b) - c(a))


def uniform_index(u, n) -> Column:
    """A whole number 0..n-1."""
    return F.floor(c(u) * c(n)).cast("long")


def occurs(u, p) -> Column:
    return c(u) < c(p)


def exponential(u) -> Column:
    return -F.log(c(u))


def normal(u, v) -> Column:
    """A standard normal variate from two uniform ones."""
    return F.sqrt(-2 * F.log(c(u))) * F.cos(2 * pi * c(v))


def choose(u, weights: Sequence[float]) -> Column:
    """Number of the option that a uniform number falls on, options as wide as their weights; roulette over operators."""
    total, run, out = sum(weights), 0.0, F.lit(len(weights) - 1)
    for k in range(len(weights) - 2, -1, -1):
        run = sum(weights[: k + 1]) / total
        out = F.when(c(u) < run, F.lit(k)).otherwise(out)
    return out.cast("long")


def polyline_crossings(a, b) -> Column:
    """Points where a segment of one polyline crosses one of the other, in order of both."""
    pairs = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda k: F.struct(F.get(p, k).alias("p"), F.get(p, k + 1).alias("q")))
    xy = lambda s: (s["x"], s["y"])

    def meet(s, t):
        ends = (xy(s["p"]), xy(s["q"]), xy(t["p"]), xy(t["q"]))
        return F.when(segments_cross(*ends), line_intersection(*ends))

    a, b = c(a), c(b)
    every = F.flatten(F.transform(pairs(a), lambda s: F.transform(pairs(b), lambda t: meet(s, t))))
    return F.when((F.size(a) > 1) & (F.size(b) > 1), F.filter(every, lambda p: p.isNotNull())).otherwise(F.filter(a, lambda p: F.lit(False)))


def increasing(polyline, step: float = 100.0) -> Column:
    """A polyline whose x grows: each point is the first later one beyond the point before, or else a ``step`` beyond at the height of the last."""
    p = c(polyline)

    def next_point(done, k):
        last = F.element_at(done, -1)
        beyond = F.filter(F.slice(p, k + 1, F.size(p)), lambda q: q["x"] > last["x"])
        other = F.struct((last["x"] + step).alias("x"), F.element_at(p, -1)["y"].alias("y"))
        return F.concat(done, F.array(F.when(F.size(beyond) > 0, F.get(beyond, 0)).otherwise(other)))

    return F.when(F.size(p) > 1, F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.slice(p, 1, 1), next_point)).otherwise(p)
