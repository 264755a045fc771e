"""Readers and writers of point, grid, link, statistics and configuration texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line): lines of one file in order. The readers of Spark split only at line ends here, and a file's row index is its own."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def _numbers(line) -> Column:
    return F.transform(F.expr(f"regexp_extract_all({line}, r'{NUMBER}', 0)"), lambda t: t.cast("double"))


def read_tsp(spark: SparkSession, path: str) -> DataFrame:
    """TSPLIB points (id, x, y): the rows of three numbers after the header."""
    row = rf"^\s*\d+\s+{NUMBER}\s+{NUMBER}\s*$"
    t = spark.read.text(path).where(F.col("value").rlike(row)).select(F.split(F.trim("value"), r"\s+").alias("t"))
    return t.select(F.col("t")[0].cast("long").alias("id"), F.col("t")[1].cast("double").alias("x"), F.col("t")[2].cast("double").alias("y"))


def read_uniform(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """A count, then that many rows of coordinates: (id, x, y[, z]), id in order of lines from 0."""
    x = _lines(spark, path).select("n", F.split(F.trim("line"), r"\s+").alias("t")).where(F.size("t") == dims).where(F.col("t")[0] != "")
    return x.select((F.row_number().over(Window.orderBy("n")) - 1).cast("long").alias("id"), *[F.col("t")[k].cast("double").alias(a) for k, a in zip(range(dims), "xyz")])


def read_valued_points(spark: SparkSession, path: str, dims: int = 3) -> DataFrame:
    """Rows ``x y z value``; the value plays no part."""
    x = _lines(spark, path).select("n", F.split(F.trim("line"), r"\s+").alias("t")).where(F.size("t") >= 4)
    return x.select((F.row_number().over(Window.orderBy("n")) - 1).cast("long").alias("id"), *[F.col("t")[k].cast("double").alias(a) for k, a in zip(range(dims), "xyz")])


def read_grid(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``Width = w Height = h [Depth = d]`` and row-major values: (i, j, k, names...), k null without depth."""
    raw = spark.read.text(path, wholetext=True).select("value")
    size = lambda key: F.nullif(F.regexp_extract("value", rf"{key}\s*=\s*(\d+)", 1), F.lit("")).cast("long")
    body = F.regexp_replace("value", r"(?:Width|Height|Depth)\s*=\s*\d+", " ")
    x = raw.select(size("Width").alias("w"), size("Height").alias("h"), size("Depth").alias("d"), body.alias("body")).select("w", "h", "d", _numbers("body").alias("v"))
    n = len(names)
    at = x.select("w", "h", "d", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("v") / n).cast("int") - 1), lambda k: F.slice("v", k * n + 1, n))).alias("at", "t"))
    return at.select((F.col("at") % F.col("w")).cast("long").alias("i"), (F.floor(F.col("at") / F.col("w")) % F.col("h")).cast("long").alias("j"), F.when(F.col("d").isNotNull(), F.floor(F.col("at") / (F.col("w") * F.col("h")))).alias("k"), *[F.col("t")[m].alias(c) for m, c in enumerate(names)])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a file by its suffix: .tsp, .2d, .3d, .points (z where it has depth or three values)."""
    suffix = path.rpartition(".")[2]
    if suffix == "2d" or suffix == "3d":
        return read_uniform(spark, path, int(suffix[0]))
    if suffix == "points":
        return read_grid(spark, path, ["x", "y"]).select((F.row_number().over(Window.orderBy("k", "j", "i")) - 1).cast("long").alias("id"), "x", "y")
    return read_tsp(spark, path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Adjacency ``NodeP = x y NumLinks = k`` and k pairs: distinct edges (src < dst), node number y * width + x."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"Width\s*=\s*(\d+)", 1).cast("long").alias("w"), F.explode(F.slice(F.split("value", r"NodeP\s*=\s*"), 2, 1 << 30)).alias("node"))
    x = raw.select("w", F.expr(r"transform(regexp_extract_all(regexp_replace(node, r'NumLinks\s*=\s*\d+', ' '), r'-?\d+', 0), t -> cast(t as bigint))").alias("v"))
    me = F.col("v")[1] * F.col("w") + F.col("v")[0]
    ends = x.where(F.size("v") >= 4).select(me.alias("a"), "w", "v", F.explode(F.expr("sequence(1, cast(size(v) / 2 as int) - 1)")).alias("k"))
    ends = ends.select("a", F.expr("v[2 * k + 1] * w + v[2 * k]").alias("b"))
    return ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """INI text as (section, key, value); comments begin with # or ;."""
    x = _lines(spark, path).select("n", F.trim(F.regexp_replace("line", r"[#;].*$", "")).alias("line")).where("line <> ''")
    x = x.withColumn("section", F.last(F.nullif(F.regexp_extract("line", r"^\[(.*)\]$", 1), F.lit("")), ignorenulls=True).over(Window.orderBy("n")))
    kv = F.split("line", "=", 2)
    return x.where(F.col("line").contains("=")).select("section", F.trim(kv[0]).alias("key"), F.trim(kv[1]).alias("value"))


#: Fixed names, in order, of the columns of run statistics.
STATS = (
    "iteration", "global_objectif", "duree_s", "duree_sxx", "cuda_ms", "benchmark", "size", "length",
    "timeFlatten", "timeTerminate", "timeFindMin1", "timeFindMin2", "timeUnion",
    "timeCumulativeFlatten", "timeCumulativeFindMin1", "timeCumulativeFindMin2", "timeCumulativeUnion", "timeCumulativeTerminate",
)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Rows of run statistics after their header, blank lines left out; columns as the header names them, as text."""
    lines = _lines(spark, path).select("n", F.split(F.trim("line"), r"\s+").alias("t")).where("size(t) > 1")
    head = lines.orderBy("n").first()
    return lines.where(F.col("n") > head["n"]).select(*[F.col("t")[k].alias(f"{name}") for k, name in enumerate(head["t"])])


# --- Writers: text that one task writes, since the formats have one header a file -------------------


def _as_text(rows: DataFrame, order: list[str], line: Column, header: Column | str) -> DataFrame:
    """One row of text: a header and the lines in order."""
    body = rows.agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))).alias("ls"), *([] if isinstance(header, str) else [header.alias("head")]))
    head = F.lit(header) if isinstance(header, str) else F.col("head")
    return body.select(F.concat_ws("\n", head, F.array_join(F.transform("ls", lambda s: s["line"]), "\n")).alias("value"))


def write_grid(grid: DataFrame, path: str, names: list[str]) -> None:
    """(i, j, names) as ``Width = w Height = h`` and row-major values."""
    header = F.concat(F.lit("Width = "), (F.max("i") + 1).cast("string"), F.lit(" Height = "), (F.max("j") + 1).cast("string"))
    _as_text(grid, ["j", "i"], F.concat_ws(" ", *[F.col(n).cast("string") for n in names]), header).write.text(path)


def write_links(edges: DataFrame, nodes: DataFrame, path: str, wide: int | None = None) -> None:
    """Edges (src, dst) of nodes numbered from 0 as adjacency of a net ``wide`` nodes wide, node number y * wide + x; of an n x 1 net without it."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("id", "b").groupBy("id").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    own = nodes.select("id").join(both, "id", "left").select("id", F.coalesce("bs", F.array().cast("array<bigint>")).alias("bs"))
    x, y = ((lambda v: v % wide), (lambda v: F.floor(v / wide))) if wide else ((lambda v: v), (lambda v: F.lit(0)))
    place = lambda v: F.concat(F.lit(" "), x(v).cast("string"), F.lit(" "), y(v).cast("string"))
    line = F.concat(F.lit("NodeP ="), place(F.col("id")), F.lit(" NumLinks = "), F.size("bs").cast("string"), F.array_join(F.transform("bs", place), ""))
    size = (F.lit(wide), F.floor(F.max("id") / wide) + 1) if wide else (F.max("id") + 1, F.lit(1))
    header = F.concat(F.lit("Width = "), size[0].cast("string"), F.lit(" Height = "), size[1].cast("string"))
    _as_text(own, ["id"], line, header).write.text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    _as_text(stats, ["iteration"], F.concat_ws(" ", *[F.col(c).cast("string") for c in stats.columns]), " ".join(stats.columns)).write.text(path)


def generate_points(spark: SparkSession, n: int, dims: int, seed: int, size: float = 1000.0) -> DataFrame:
    """n points evenly at random in a box: (id, x, y[, z])."""
    return spark.range(n).select("id", *[(F.rand(seed + k) * size).alias(a) for k, a in zip(range(dims), "xyz")])
