"""Synthetic graphs as scan leaves: ranges and predicates, no loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import random_unit
from .graph import Graph, normalise


def lattice(spark: SparkSession, *sizes: int) -> Graph:
    """The grid of up to three dimensions; node_id numbers cells with x fastest."""
    nx, ny, nz = (*sizes, 1, 1)[:3]
    nodes = spark.range(nx * ny * nz).select(F.col("id").alias("node_id"), F.expr(f"cast(id % {nx} as int)").alias("x"), F.expr(f"cast(id div {nx} % {ny} as int)").alias("y"), F.expr(f"cast(id div {nx * ny} as int)").alias("z"))
    steps = [("x", nx, 1), ("y", ny, nx), ("z", nz, nx * ny)]
    near = F.array_compact(F.array(*[F.when(F.col(c) < n - 1, F.col("node_id") + s) for c, n, s in steps]))
    return Graph(nodes, nodes.select(F.col("node_id").alias("u"), F.explode(near).alias("v")))


def torus(spark: SparkSession, n: int) -> Graph:
    nodes = lattice(spark, n, n).nodes.drop("z")
    ends = F.array(F.expr(f"y * {n} + (x + 1) % {n}"), F.expr(f"(y + 1) % {n} * {n} + x"))
    return Graph(nodes, normalise(nodes.select(F.col("node_id").alias("u"), F.explode(ends).alias("v"))))


def with_diagonals(spark: SparkSession, size: int, rising: Column, falling: Column | None = None) -> Graph:
    """A square grid with an edge to the north-east where ``rising`` holds and to the south-east where ``falling`` does,
    as far as that stays within the grid."""
    g = lattice(spark, size, size)
    up = g.nodes.where(rising & (F.col("x") < size - 1) & (F.col("y") < size - 1)).select(F.col("node_id").alias("u"), (F.col("node_id") + size + 1).alias("v"))
    edges = g.edges.union(up)
    if falling is not None:
        down = g.nodes.where(falling & (F.col("x") < size - 1) & (F.col("y") > 0)).select(F.col("node_id").alias("u"), (F.col("node_id") - size + 1).alias("v"))
        edges = edges.union(down)
    return Graph(g.nodes, normalise(edges))


def diagonal_mask(kind: str, m: int, width: float = 2.5) -> tuple[int, Column, Column | None]:
    """(grid size, where edges rise, where they fall) of a pattern of diagonals."""
    x, y = F.col("x"), F.col("y")
    band = lambda c, n, w: c.between((n - w) * m - 1, n * m - 2) | c.between(0, w * m - 1)
    middle = lambda c: c.between(width * m - 1, (6 - width) * m - 1)
    even = x % 2 == 0
    masks = {
        "biased": (6, band(x, 6, width) & (y <= 6 * m - 2), None),
        "debiased": (6, even & band(x, 6, width) & (y <= 6 * m - 2), ~even & band(x, 6, width) & (y <= 6 * m - 2)),
        "biased_1": (4, band(y, 4, 1.5) & (x <= 4 * m - 2), None),
        "debiased_1": (4, even & band(y, 4, 1.5) & (x <= 4 * m - 2), ~even & band(y, 4, 1.5) & (x <= 4 * m - 2)),
        "four_squares": (6, band(x, 6, width) & band(y, 6, width), None),
        "one_line": (6, middle(x) & y.between(2.5 * m, 3.5 * m), None),
        "anti_four_squares": (6, middle(x) & (y <= 6 * m - 3) | middle(y) & (x <= 6 * m - 3), None),
        "center_square": (6, middle(x) & (y <= 6 * m - 3) & middle(y) & (x <= 6 * m - 3), None),
        "meta_mander": (6, ~((x > 1.5 * m) & (x <= 2.5 * m) | (x > 3.5 * m) & (x <= 4.5 * m)) & ~((x > 2.5 * m) & (x <= 3.5 * m) & (y > 2 * m) & (y <= 3 * m)) & (y < 6 * m - 2) & (x < 6 * m - 1), None),
    }
    n, up, down = masks[kind]
    return n * m, up, down


def diagonals(spark: SparkSession, kind: str, m: int, width: float = 2.5) -> Graph:
    return with_diagonals(spark, *diagonal_mask(kind, m, width))


def random_diagonals(spark: SparkSession, m: int, target: Column, p_1: float = 0.9, p_2: float = 0.2, seed: int = 1) -> Graph:
    """Diagonals with probability p_2 everywhere and p_1 where ``target`` holds."""
    first, second = random_unit(seed, F.col("node_id"), 0), random_unit(seed, F.col("node_id"), 1)
    return with_diagonals(spark, 6 * m, (first < p_2) | ((second < (p_1 - p_2) / (1 - p_2)) & target))


def disc(spark: SparkSession, r: int) -> Graph:
    """Lattice points nearer to the origin than r + 1/2."""
    side = 2 * r + 1
    nodes = spark.range(side * side).select(F.col("id").alias("node_id"), F.expr(f"cast(id % {side} - {r} as int)").alias("x"), F.expr(f"cast(id div {side} - {r} as int)").alias("y")).where(f"4 * (x * x + y * y) < {side * side}")
    inside = lambda dx, dy: f"CASE WHEN 4 * ((x + {dx}) * (x + {dx}) + (y + {dy}) * (y + {dy})) < {side * side} THEN node_id + {dx + dy * side} END"
    return Graph(nodes, nodes.select(F.col("node_id").alias("u"), F.explode(F.expr(f"array_compact(array({inside(1, 0)}, {inside(0, 1)}))")).alias("v")))


def disc_faces(spark: SparkSession, r: int) -> DataFrame:
    """Unit faces, by their lower left corner, all of whose corners are in the disc."""
    corners = " AND ".join(f"4 * ((x + {dx}) * (x + {dx}) + (y + {dy}) * (y + {dy})) < {(2 * r + 1) ** 2}" for dx in (0, 1) for dy in (0, 1))
    return disc(spark, r).nodes.where(corners).select("x", "y", (F.col("x") + 0.5).alias("cx"), (F.col("y") + 0.5).alias("cy"))


def scaled_disc(spark: SparkSession, r: int) -> DataFrame:
    """Points (x / r - 2, y / r - 2) of a 4r grid within the unit disc, with radius and angle in units of pi."""
    n = 4 * r
    nodes = lattice(spark, n, n).nodes.drop("z").withColumn("px", F.col("x") / F.lit(float(r)) - 2).withColumn("py", F.col("y") / F.lit(float(r)) - 2)
    return nodes.withColumn("rho2", F.col("px") * F.col("px") + F.col("py") * F.col("py")).where("rho2 < 1").withColumn("angle", F.atan2("py", "px") / F.pi())


def in_windows(angle: Column, windows: list[tuple[float, float]]) -> Column:
    """Whether an angle, modulo a half, is strictly within one of the windows."""
    a = F.pmod(angle, F.lit(0.5))
    out = F.lit(False)
    for lo, hi in windows:
        out = out | (a > lo) & (a < hi)
    return out


# Windows of the angle modulo a half, and annuli.
SECTORS = [(0.0625, 0.185), (0.3125, 0.44)]
WIDE_SECTORS = [(0.03, 0.22), (0.28, 0.47)]


def disc_pattern(spark: SparkSession, r: int, kind: str, extra: float = 0.0) -> DataFrame:
    """(x, y, dx) of the diagonals of a patterned disc: from (x, y) to (x + dx, y + 1)."""
    d = scaled_disc(spark, r)
    a, rho2 = F.col("angle"), F.col("rho2")
    ring = lambda lo, hi: (rho2 > lo * lo) & (rho2 < hi * hi)
    where = {
        "annulus": ring(1 / 3, 2 / 3),
        "sectors": ((a >= -0.6) & (a < -0.3) | (a >= 0) & (a < 0.3) | (a >= 0.6) & (a < 0.9)) & (rho2 < 0.81),
        "signed": ring(1 / 3, 2 / 3),
        "windows": in_windows(a, SECTORS) & ring(1 / 3, 0.8),
        "wide_windows": in_windows(a, [(lo - extra, hi + extra) for lo, hi in WIDE_SECTORS]) & ring(0.3, 0.8),
    }[kind]
    dx = F.when(a > 0, 1).otherwise(-1) if kind == "signed" else F.lit(1)
    return d.where(where).select("x", "y", dx.cast("int").alias("dx"))


def layered(spark: SparkSession, width: int, layers: int) -> DataFrame:
    """node_id, i and layer 0 to ``layers`` of a layered digraph's nodes."""
    return spark.range(width * (layers + 1)).select(F.col("id").alias("node_id"), F.expr(f"cast(id % {width} as int)").alias("i"), F.expr(f"cast(id div {width} as int)").alias("layer"))


def layered_edges(spark: SparkSession, kind: str, width: int, log_layers: int, density: float = 0.5, seed: int = 1) -> DataFrame:
    """(layer, i, j): edges from place i of a layer to place j of the next, of 2 ** log_layers + 1 layers."""
    d = 2**log_layers
    every = layered(spark, width, d).where(f"layer < {d}").select("layer", "i").join(spark.range(width).select(F.col("id").cast("int").alias("j")))
    if kind == "complete":
        return every
    if kind == "disjoint":
        return every.where(f"CASE WHEN layer = 0 THEN i = 0 WHEN layer = {d - 1} THEN j = 0 ELSE i = j END")
    if kind == "diamonds":
        inner = f"layer > 0 AND layer < {d - 1} AND abs(i - j) = 1 AND ((layer % 2 = 1 AND i % 3 = 1 AND j div 3 = i div 3) OR (layer % 2 = 0 AND j % 3 = 1 AND j div 3 = i div 3))"
        return every.where(f"layer = 0 AND i = 0 AND j % 3 = 1 OR layer = {d - 1} AND i % 3 = 1 AND j = 0 OR {inner}")
    if kind == "bernoulli":
        return every.where(random_unit(seed, F.col("layer"), F.col("i") * width + F.col("j")) < density)
    draws = layered(spark, width, d).where(f"layer < {d}").select("layer", "i", F.explode(F.sequence(F.lit(1), F.lit(max(1, int(density * width))))).alias("k"))
    return draws.select("layer", "i", F.floor(random_unit(seed, F.col("layer") * width + F.col("i"), F.col("k")) * width).cast("int").alias("j")).distinct()


def doubled_tree(spark: SparkSession, m: int, k: int) -> Graph:
    """Two m-ary trees of depth k glued at their leaves: heap numbers, half +1 above, -1 below, 0 at the leaves."""
    size = sum(m**x for x in range(k + 1))
    inner = size - m**k
    starts = [sum(m**x for x in range(level)) for level in range(k + 2)]
    level = F.lit(0)
    for x, start in enumerate(starts[1:-1], 1):
        level = F.when(F.col("heap") >= start, x).otherwise(level) if x == 1 else level + F.when(F.col("heap") >= start, 1).otherwise(0)
    top = spark.range(size).select(F.col("id").alias("heap"), F.lit(1).alias("half")).union(spark.range(inner).select("id", F.lit(-1)))
    nodes = top.withColumn("level", level.cast("int")).withColumn("half", F.expr(f"CASE WHEN heap >= {inner} THEN 0 ELSE half END"))
    nodes = nodes.withColumn("node_id", F.expr(f"CASE WHEN half = -1 THEN {size} + heap ELSE heap END"))
    up = spark.range(1, size).select(F.expr(f"(id - 1) div {m}").alias("u"), F.col("id").alias("v"))
    down = spark.range(1, size).select(F.expr(f"{size} + (id - 1) div {m}").alias("u"), F.expr(f"CASE WHEN id >= {inner} THEN id ELSE {size} + id END").alias("v"))
    return Graph(nodes.select("node_id", "level", "half"), normalise(up.union(down)))


def gadget(spark: SparkSession, depth: int, clasp: bool = False) -> Graph:
    """Nested triangles: layer k has corners 3k, 3k+1, 3k+2; each corner meets the midpoints of the next layer's sides."""
    n = 3 * (depth + 1)
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.expr("cast(id div 3 as int)").alias("level"))
    ring = spark.range(n).select(F.col("id").alias("u"), F.expr("id - id % 3 + (id + 1) % 3").alias("v"))
    spokes = spark.range(n - 3).select(F.col("id").alias("u"), F.col("id") + 3).union(spark.range(n - 3).select(F.col("id"), F.expr("id - id % 3 + 3 + (id + 1) % 3")))
    edges = ring.union(spokes)
    if clasp:
        nodes = nodes.union(spark.range(n, n + 1).select("id", F.lit(-1)))
        edges = edges.union(spark.range(3).select("id", F.lit(n).cast("long")))
    return Graph(nodes, normalise(edges))


def replace_edges(g: Graph, inner_nodes: int, gadget_edges: DataFrame) -> DataFrame:
    """Every edge of g replaced by a copy of a gadget: its node -1 is the edge's u, -2 its v, 0.. are new. Edges, by string names."""
    name = lambda x: F.when(F.col(x) == -1, F.concat(F.lit("n"), F.col("u"))).when(F.col(x) == -2, F.concat(F.lit("n"), F.col("v"))).otherwise(F.concat_ws("_", F.lit("e"), "u", "v", x))
    return g.edges.join(gadget_edges.where(f"a < {inner_nodes} AND b < {inner_nodes}")).select(name("a").alias("u"), name("b").alias("v"))
