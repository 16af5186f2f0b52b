"""Sets, paths, permutations and node scores as keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import dense_ids, normalise


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two sets has, of the same columns."""
    return a.distinct().unionAll(b.distinct()).groupBy(*a.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def subsets_of_size(spark: SparkSession, n: int, d: int) -> DataFrame:
    """(mask) of the d-subsets of n things: the monomials of degree d."""
    return spark.range(1 << n).where(F.bit_count("id") == d).select(F.col("id").alias("mask"))


def bit_strings(spark: SparkSession, m: int) -> DataFrame:
    return spark.range(1 << m).select(F.col("id").alias("mask"), F.lpad(F.bin("id"), m, "0").alias("bits"))


def path_edges(path: DataFrame) -> DataFrame:
    """(path_id, pos, u, v): consecutive pairs of path(path_id, pos, node_id)."""
    w = Window.partitionBy("path_id").orderBy("pos")
    return path.select("path_id", "pos", F.col("node_id").alias("u"), F.lead("node_id").over(w).alias("v")).where("v IS NOT NULL")


def edge_weights(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(u, v, weight): the sum of the ends' weights(node_id, weight)."""
    a, b = weights.select(F.col("node_id").alias("u"), F.col("weight").alias("a")), weights.select(F.col("node_id").alias("v"), F.col("weight").alias("b"))
    return edges.join(a, "u").join(b, "v").select("u", "v", (F.col("a") + F.col("b")).alias("weight"))


def inverse(permutation: DataFrame) -> DataFrame:
    """The inverse of permutation(perm_id, i, image)."""
    return permutation.select("perm_id", F.col("image").alias("i"), F.col("i").alias("image"))


def reorder(rows: DataFrame, permutation: DataFrame) -> DataFrame:
    """(perm_id, i, v): place i holds the value of rows(i, v) at its image."""
    return permutation.join(rows.withColumnRenamed("i", "image"), "image").select("perm_id", "i", "v")


def tree_scores(members: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Scores of sets(set_id, node_id) of a doubled tree's nodes(node_id, level, half) of depth k: depth-weighted, middle, balance, weighted balance, roots."""
    m = members.join(nodes, "node_id")
    total = lambda c: F.sum(c).cast("long")
    return m.groupBy("set_id").agg(
        total(F.col("level")).alias("depth_weighted"), total((F.col("level") == k).cast("int")).alias("middle"), total(F.col("half")).alias("balance"),
        total(F.col("half") * F.pow(F.lit(10.0), F.lit(k) - F.col("level"))).alias("weighted_balance"), total(F.when(F.col("level") == 0, F.when(F.col("half") == 1, 1).otherwise(-10)).otherwise(0)).alias("roots"),
    )


def fractional(x: Column) -> Column:
    return x - F.floor(x)


def in_box(points: DataFrame, key: str, coordinates: str, limit: float = 0.5) -> DataFrame:
    """(key, share): of points with an array of coordinates, the share whose fractional parts are all ``limit`` at most."""
    inside = F.forall(coordinates, lambda x: x - F.floor(x) <= limit)
    return points.groupBy(key).agg(F.avg(inside.cast("double")).alias("share"))


def covering_map(points: DataFrame, n: int) -> DataFrame:
    """points(x, y) of the plane on the n by n torus."""
    return points.withColumn("x", F.pmod("x", F.lit(n))).withColumn("y", F.pmod("y", F.lit(n)))


def north_west(cells: DataFrame) -> DataFrame:
    """(set_id, x, y) of each set's cell of largest y, then least x."""
    first = F.max(F.struct("y", (-F.col("x")).alias("x")))
    return cells.groupBy("set_id").agg(first.alias("m")).select("set_id", (-F.col("m.x")).alias("x"), F.col("m.y").alias("y"))


def shortest_paths(edges: DataFrame, source: int, rounds: int) -> DataFrame:
    """(node_id, dist): least total weight of paths of up to ``rounds`` edges from source over undirected edges(u, v, weight)."""
    both = edges.select("u", "v", "weight").union(edges.select("v", "u", "weight")).checkpoint()
    dist = edges.sparkSession.sql(f"SELECT {source}L AS node_id, 0L AS dist")
    for _ in range(rounds):
        step = dist.join(both, F.col("node_id") == F.col("u")).select(F.col("v").alias("node_id"), (F.col("dist") + F.col("weight")).alias("dist"))
        new = dist.union(step).groupBy("node_id").agg(F.min("dist").alias("dist")).checkpoint()
        if not new.join(dist, ["node_id", "dist"], "left_anti").limit(1).count():
            return new
        dist = new
    return dist


def contiguous_chunks(rows: DataFrame, order: str, n: int) -> DataFrame:
    """rows with ``chunk``: n contiguous chunks of equal size by order, the remainder in the last."""
    placed = dense_ids(rows, order, name="_k")
    total = placed.count()
    return placed.withColumn("chunk", F.least(F.lit(n - 1), F.floor(F.col("_k") / max(1, total // n))).cast("int")).drop("_k")


def side_counts(cut: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(plan_id, left, right, bottom, top): cut edges with both ends on an outer side of a grid."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    on = lambda c, k: F.count_if((F.col(f"u{c}") == k) & (F.col(f"v{c}") == k))
    return cut.join(a, "u").join(b, "v").groupBy("plan_id").agg(on("x", 0).alias("left"), on("x", size - 1).alias("right"), on("y", 0).alias("bottom"), on("y", size - 1).alias("top"))


def average_curves(curves: DataFrame) -> DataFrame:
    """(t, v): pointwise mean of curves(curve_id, t, v)."""
    return curves.groupBy("t").agg(F.avg("v").alias("v"))


def dual_distance(dual_edges: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """(face, dist): breadth-first distance in dual_edges(a, b) from the faces in sources(face)."""
    both = dual_edges.select(F.col("a").alias("f"), F.col("b").alias("g")).union(dual_edges.select("b", "a")).distinct().checkpoint()
    seen = sources.select("face").distinct().withColumn("dist", F.lit(0))
    last = seen
    for k in range(1, rounds + 1):
        last = last.join(both, F.col("face") == F.col("f")).select(F.col("g").alias("face")).distinct().join(seen, "face", "left_anti").withColumn("dist", F.lit(k)).checkpoint()
        if not last.limit(1).count():
            break
        seen = seen.union(last)
    return seen


def face_flip(cycle: DataFrame, face: DataFrame) -> DataFrame:
    """The edges of a cycle after a face's edges are added modulo 2, both as (u, v)."""
    return symmetric_difference(normalise(cycle), normalise(face))
