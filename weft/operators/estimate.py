"""Estimators, conformal maps and small linear algebra as column expressions and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.portable import cdiv, cmul, let, pair


def importance_ratio(samples: DataFrame, value: Column, likelihood: Column) -> DataFrame:
    """One row: mean of value / likelihood, mean of 1 / likelihood, and their ratio, from rows drawn with that likelihood."""
    return samples.agg(F.avg(value / likelihood).alias("total"), F.avg(1 / likelihood).alias("size"), (F.avg(value / likelihood) / F.avg(1 / likelihood)).alias("ratio"))


def map_up(z: Column) -> Column:
    """The disc to the half plane: i (1 + z) / (1 - z)."""
    w = cdiv(pair(1 + z["re"], z["im"]), pair(1 - z["re"], -z["im"]))
    return pair(-w["im"], w["re"])


def map_down(w: Column) -> Column:
    """Back: (w - i) / (w + i)."""
    return cdiv(pair(w["re"], w["im"] - 1), pair(w["re"], w["im"] + 1))


def hit_probability(rho: Column) -> Column:
    """1 - (1 - rho**2) ** (5/8)."""
    return 1 - F.pow(1 - rho * rho, F.lit(5 / 8))


def project_zero_sums(m: DataFrame) -> DataFrame:
    """m(m_id, i, j, v) less its row and column means plus the grand mean: the projection onto zero row and column sums."""
    rows, cols, all_ = m.groupBy("m_id", "i").agg(F.avg("v").alias("r")), m.groupBy("m_id", "j").agg(F.avg("v").alias("c")), m.groupBy("m_id").agg(F.avg("v").alias("g"))
    return m.join(rows, ["m_id", "i"]).join(cols, ["m_id", "j"]).join(all_, "m_id").select("m_id", "i", "j", (F.col("v") - F.col("r") - F.col("c") + F.col("g")).alias("v"))


def doubly_stochastic(m: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(m_id, ok): entries of 0 to 1, rows and columns sum to 1."""
    rows = m.groupBy("m_id", "i").agg(F.sum("v").alias("s")).union(m.groupBy("m_id", "j").agg(F.sum("v").alias("s")))
    sums = rows.groupBy("m_id").agg(F.max(F.abs(F.col("s") - 1)).alias("off"))
    return m.groupBy("m_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).join(sums, "m_id").select("m_id", F.expr(f"lo >= -{tolerance} AND hi <= 1 + {tolerance} AND off <= {tolerance}").alias("ok"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of sparse a(i, k, v) times b(k, j, v)."""
    return a.withColumnRenamed("v", "av").join(b.withColumnRenamed("v", "bv"), "k").groupBy("i", "j").agg(F.sum(F.col("av") * F.col("bv")).alias("v"))


def scatter_matrix(data: DataFrame, row_id: str, dims: list[str]) -> DataFrame:
    """(i, j, v): sums over rows of products of deviations from the means."""
    means = data.agg(*[F.avg(c).alias(f"_{c}") for c in dims])
    d = data.join(F.broadcast(means)).select(row_id, *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in dims])
    sums = d.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(dims) for j, b in enumerate(dims)])
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{i}_{j}").alias("v")) for i in range(len(dims)) for j in range(len(dims))])
    return sums.select(F.explode(pairs).alias("p")).select("p.i", "p.j", "p.v")


def midpoint_path(spark, levels: int, seed: int = 1, scheme: str = "as_written") -> DataFrame:
    """(t, pos): a Brownian path on dyadic times of [0, 1] by midpoints, each level from the one before; noise N / 2**(i+1), or Levy's 2**(-(i+1)/2)."""
    from ..functions.portable import random_unit

    def normal(k: Column, level: int) -> Column:
        return F.sqrt(-2 * F.log(random_unit(seed, k, 2 * level) + 1e-12)) * F.cos(2 * F.pi() * random_unit(seed, k, 2 * level + 1))

    # Rows are intervals; each is split at its midpoint, without a join.
    path = spark.range(1).select(F.col("id").alias("t"), F.lit(0.0).alias("lo"), normal(F.lit(1), 0).alias("hi"))
    for level in range(1, levels + 1):
        noise = 0.5 / 2**level if scheme == "as_written" else 2 ** (-(level + 1) / 2)
        path = path.withColumn("mid", (F.col("lo") + F.col("hi")) / 2 + normal(2 * F.col("t") + 1, level) * noise)
        halves = F.array(F.struct((2 * F.col("t")).alias("t"), "lo", F.col("mid").alias("hi")), F.struct((2 * F.col("t") + 1).alias("t"), F.col("mid").alias("lo"), "hi"))
        path = path.select(F.explode(halves).alias("p")).select("p.t", "p.lo", "p.hi")
    ends = F.when(F.col("t") == 2**levels - 1, F.array(F.struct("t", F.col("lo").alias("pos")), F.struct((F.col("t") + 1).alias("t"), F.col("hi").alias("pos")))).otherwise(F.array(F.struct("t", F.col("lo").alias("pos"))))
    path = path.select(F.explode(ends).alias("p")).select("p.t", "p.pos")
    return path.select((F.col("t") / F.lit(float(2**levels))).alias("t"), "pos")


def planar_brownian(spark, levels: int, seeds: tuple[int, int] = (1, 2), scheme: str = "as_written") -> DataFrame:
    """(t, x, y): two independent paths on the same times."""
    x, y = (midpoint_path(spark, levels, k, scheme).withColumnRenamed("pos", name) for k, name in zip(seeds, "xy", strict=True))
    return x.join(y, "t")


def rotate(z: Column, by: Column, turn: int = 1) -> Column:
    """z turned by the angle of ``by``; with turn -1 the other way, which takes ``by`` itself to the positive axis."""
    size = F.sqrt(by["re"] * by["re"] + by["im"] * by["im"])
    return cmul(z, pair(by["re"] / size, turn * by["im"] / size))


def disc_automorphism(x: Column, y: Column, p: Column, turn: int = 1) -> Column:
    """p after all three are turned by the angle of y and the half plane is moved so that x, on the circle, comes to -1; 1 stays where it is."""
    up = lambda z, use: let(rotate(z, y, turn), lambda r: let(map_up(r), use))
    return up(p, lambda w: up(x, lambda o: let(pair(w["re"] - o["re"], w["im"] - o["im"]), map_down)))


def align_paths(path: DataFrame, turn: int = 1) -> DataFrame:
    """(path_id, idx, x, y): disc_automorphism() of the points of path(path_id, idx, x, y) with its first and last point; the last becomes 1."""
    z = pair(F.col("x"), F.col("y"))
    ends = path.groupBy("path_id").agg(F.min_by(z, "idx").alias("first"), F.max_by(z, "idx").alias("last"), F.max("idx").alias("end"))
    moved = F.when(F.col("idx") < F.col("end"), disc_automorphism(F.col("first"), F.col("last"), z, turn)).otherwise(pair(F.lit(1.0), F.lit(0.0)))
    return path.join(ends, "path_id").withColumn("_z", moved).select("path_id", "idx", F.col("_z.re").alias("x"), F.col("_z.im").alias("y"))


def incidence(edges: DataFrame) -> DataFrame:
    """(i, k, c) of edges(edge_id, u, v): -1 at u and 1 at v. Times its transpose it is the Laplacian, so that it serves as its factor."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("i"), F.lit(-1.0).alias("c")), F.struct(F.col("v").alias("i"), F.lit(1.0).alias("c")))).alias("p"), F.col("edge_id").alias("k")).select("p.i", "k", "p.c")


def gaussian_products(spark, factor: DataFrame, samples: int, n_nodes: int, seed: int = 1, signed: bool = True) -> DataFrame:
    """(sample_id, value): products over i of normals whose covariance is C times its transpose, of factor(i, k, c); their mean is the number of perfect
    matchings, up to the sign (-1) ** (n_nodes div 2) of the Laplacian, taken out by ``signed``."""
    from ..functions.portable import random_unit

    draw = lambda k: random_unit(seed, F.col("sample_id"), 2 * F.col("k") + k)
    normals = factor.select("k").distinct().join(spark.range(samples).withColumnRenamed("id", "sample_id"))
    normals = normals.select("sample_id", "k", (F.sqrt(-2 * F.log(draw(0) + 1e-12)) * F.cos(2 * F.pi() * draw(1))).alias("z"))
    sums = normals.join(factor, "k").groupBy("sample_id", "i").agg(F.sum(F.col("c") * F.col("z")).alias("s"))
    sign = -1.0 if signed and n_nodes // 2 % 2 else 1.0
    return sums.groupBy("sample_id").agg((F.product("s") * sign).alias("value"))


def spread(values: DataFrame) -> DataFrame:
    """One row: mean, population variance and median of value."""
    return values.agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.median("value").alias("median"))
