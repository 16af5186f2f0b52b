"""Queries on polytopes, aligned paths, Gaussian estimates and first plans, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import pair
from ..operators import chains, estimate, generators, learn, plans, polytopes, statistics
from .graph_queries import _PLANS, _plans, grid_sql, numbered, unit_sql
from .registry import Registry

R = Registry()


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_M = 31  # edges of the lattice of 5 by 4 nodes
_CYCLES = f"""ends AS (SELECT edge_id, 0 AS q, u AS node_id FROM numbered UNION ALL SELECT edge_id, 1, v FROM numbered),
cycle AS (SELECT 2 * a.edge_id + a.q AS i, b.edge_id AS j, 1.0::DOUBLE AS v FROM ends a JOIN ends b ON a.node_id = b.node_id AND a.edge_id <> b.edge_id
UNION ALL SELECT 2 * edge_id + q, edge_id, -1.0 FROM ends UNION ALL SELECT 2 * edge_id + q, (q + 1) * {_M} + edge_id, -1.0 FROM ends)"""


def _with_right(rows: tuple[DataFrame, DataFrame]) -> DataFrame:
    """A system as one table; the right side is column -1."""
    return rows[0].union(rows[1].select("i", F.lit(-1).cast("long").alias("j"), "v"))


@R.add("cycle_cone", f"WITH {grid_sql(5, 4)}, {_CYCLES} SELECT i, j, v FROM cycle UNION ALL SELECT {2 * _M}, k, 1.0 FROM range({3 * _M}) r(k) UNION ALL SELECT {2 * _M}, -1, 40.0")
def cycle_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_right(polytopes.cycle_cone(numbered(generators.lattice(spark, 5, 4)), 20))


@R.add("cycle_box", f"WITH {grid_sql(5, 4)}, {_CYCLES} SELECT i, j, v FROM cycle UNION ALL SELECT {3 * _M - 1} - edge_id, unnest([edge_id, edge_id + {3 * _M}, -1]), 1.0 FROM numbered")
def cycle_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_right(polytopes.cycle_box(numbered(generators.lattice(spark, 5, 4))))


# Two rows and eight columns, of which some are parallel and the last is empty.
_TWO = "m AS (SELECT j, CASE WHEN j = 7 THEN 0 ELSE (j * 7 + 3) % 5 - 2 END AS a, CASE WHEN j = 7 THEN 0 ELSE (j * 3 + 1) % 4 - 1 END AS b FROM range(8) r(j))"


def _two(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    both = spark.range(7).select(F.lit(0).cast("long").alias("matrix_id"), F.col("id").alias("j"), F.expr("posexplode(array((id * 7 + 3) % 5 - 2, (id * 3 + 1) % 4 - 1))").alias("i", "v"))
    right = spark.sql("SELECT * FROM VALUES (0L, 0L, 3.0D), (0L, 1L, 2.0D) AS t(matrix_id, i, v)")
    return both.where("v <> 0").select("matrix_id", F.col("i").cast("long").alias("i"), "j", F.col("v").cast("double").alias("v")), right


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.range(64).where("id div 8 < id % 8").select(F.lit(0).cast("long").alias("matrix_id"), F.col("id").alias("subset_id"), F.explode(F.array(F.expr("id div 8"), F.expr("id % 8"))).alias("j"))


@R.add("independent_columns", f"WITH {_TWO} SELECT p.j * 8 + q.j AS subset_id, p.a * q.b <> p.b * q.a AS independent FROM m p JOIN m q ON p.j < q.j")
def independent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytopes.independent(_two(spark)[0], _pairs(spark)).select("subset_id", "independent")


@R.add("basic_solutions", f"""WITH {_TWO}, s AS (SELECT p.j AS p, q.j AS q, (3 * q.b - 2 * q.a)::DOUBLE / (p.a * q.b - p.b * q.a) AS x, (2 * p.a - 3 * p.b)::DOUBLE / (p.a * q.b - p.b * q.a) AS y FROM m p JOIN m q ON p.j < q.j AND p.a * q.b <> p.b * q.a),
l AS (SELECT p * 8 + q AS subset_id, p AS j, x, least(x, y) >= -1e-9 AS feasible FROM s UNION ALL SELECT p * 8 + q, q, y, least(x, y) >= -1e-9 FROM s) SELECT subset_id, j, round(x, 9) + 0.0::DOUBLE AS x, feasible FROM l""")
def basic_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, right = _two(spark)
    x = polytopes.basic_solutions(matrix, right, _pairs(spark))
    return x.join(polytopes.nonnegative(x, 1e-9), ["matrix_id", "subset_id"]).select("subset_id", "j", (F.round("x", 9) + 0.0).alias("x"), "feasible")


_ORDERS = f"o AS (SELECT s.i AS sample_id, m.*, row_number() OVER (PARTITION BY s.i ORDER BY {unit_sql('17', 's.i', 'm.j')}, m.j) - 1 AS pos FROM range(40) s(i), m)"


@R.add("greedy_bases", f"""WITH {_TWO}, {_ORDERS}, f AS (SELECT sample_id, arg_min(j, pos) AS j, arg_min(a, pos) AS a, arg_min(b, pos) AS b FROM o WHERE a <> 0 OR b <> 0 GROUP BY sample_id),
g AS (SELECT o.sample_id, arg_min(o.j, pos) AS j FROM o JOIN f ON f.sample_id = o.sample_id AND o.a * f.b <> o.b * f.a GROUP BY o.sample_id) SELECT sample_id, j FROM f UNION ALL SELECT sample_id, j FROM g""")
def greedy_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = polytopes.drawn_orders(spark, 8, 40, 17).select(F.lit(0).cast("long").alias("matrix_id"), F.col("sample_id").alias("order_id"), "pos", "j")
    return polytopes.greedy_bases(_two(spark)[0], orders).select(F.col("order_id").alias("sample_id"), "j")


@R.add("rejected_bases", f"""WITH {_TWO}, {_ORDERS}, p AS (SELECT x.sample_id // 8 AS sample_id, x.sample_id % 8 AS try, x.j AS p, y.j AS q FROM o x JOIN o y ON x.sample_id = y.sample_id AND x.pos = 0 AND y.pos = 1 AND x.a * y.b <> x.b * y.a),
f AS (SELECT * FROM p QUALIFY try = min(try) OVER (PARTITION BY sample_id)) SELECT sample_id, try, unnest([p, q]) AS j FROM f""")
def rejected_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = polytopes.drawn_orders(spark, 8, 40, 17).where("pos < 2").select(F.lit(0).cast("long").alias("matrix_id"), F.expr("sample_id div 8").alias("sample_id"), F.expr("sample_id % 8").alias("try"), "j")
    return polytopes.first_basis(_two(spark)[0], tries).select("sample_id", "try", "j")


_INCIDENCE = f"{grid_sql(4, 3)}, z AS (SELECT s.i AS sample_id, e.u, e.v, sqrt(-2 * ln({unit_sql('23', 's.i', '2 * e.edge_id')} + 1e-12)) * cos(2 * pi() * {unit_sql('23', 's.i', '2 * e.edge_id + 1')}) AS z FROM range(200) s(i), numbered e)"
_PRODUCTS = f"{_INCIDENCE}, y AS (SELECT sample_id, node_id, sum(z) AS y FROM (SELECT sample_id, u AS node_id, -z AS z FROM z UNION ALL SELECT sample_id, v, z FROM z) GROUP BY ALL), p AS (SELECT sample_id, product(y) AS value FROM y GROUP BY sample_id)"


def _products(spark: SparkSession) -> DataFrame:
    return estimate.gaussian_products(spark, estimate.incidence(numbered(generators.lattice(spark, 4, 3))), 200, 12, 23)


@R.add("gaussian_products", f"WITH {_PRODUCTS} SELECT sample_id, round(value, 6) AS value FROM p")
def gaussian_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark).select("sample_id", F.round("value", 6).alias("value"))


@R.add("matching_estimates", f"WITH {_PRODUCTS} SELECT round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(median(value), 6) AS median FROM p")
def matching_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.spread(_products(spark)).select(F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("median", 6).alias("median"))


def brownian_sql(name: str, levels: int, seed: int) -> str:
    """midpoint_path() as CTEs, the last of which is ``name``."""
    normal = lambda k, level: f"sqrt(-2 * ln({unit_sql(str(seed), k, str(2 * level))} + 1e-12)) * cos(2 * pi() * {unit_sql(str(seed), k, str(2 * level + 1))})"
    at = lambda level: name if level == levels else f"{name}_{level}"
    out = [f"{at(0)} AS (SELECT i AS t, CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE {normal('i', 0)} END AS pos FROM range(2) r(i))"]
    for k in range(1, levels + 1):
        out.append(f"{at(k)} AS (SELECT 2 * t AS t, pos FROM {at(k - 1)} UNION ALL SELECT 2 * a.t + 1, (a.pos + b.pos) / 2 + {normal('(2 * a.t + 1)', k)} * {0.5 / 2**k!r}::DOUBLE FROM {at(k - 1)} a JOIN {at(k - 1)} b ON b.t = a.t + 1)")
    return ", ".join(out)


@R.add("brownian_midpoints", f"WITH {brownian_sql('p', 6, 5)} SELECT t / 64.0::DOUBLE AS t, round(pos, 9) AS pos FROM p")
def brownian_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.midpoint_path(spark, 6, 5).select("t", F.round("pos", 9).alias("pos"))


@R.add("planar_brownian", f"WITH {brownian_sql('p', 5, 5)}, {brownian_sql('q', 5, 6)} SELECT p.t / 32.0::DOUBLE AS t, round(p.pos, 9) AS x, round(q.pos, 9) AS y FROM p JOIN q USING (t)")
def planar_brownian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.planar_brownian(spark, 5, (5, 6)).select("t", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


# Spirals from the circle through the disc to the circle, one for each angle.
_SPIRAL = "s AS (SELECT p AS path_id, i AS idx, (1 - sin(pi() * i / 12) * 0.8) * cos(p + 2.0 + i * 0.31) AS x, (1 - sin(pi() * i / 12) * 0.8) * sin(p + 2.0 + i * 0.31) AS y FROM range(6) a(p), range(13) b(i))"


def _aligned(turn: int) -> str:
    """The automorphism written out: h(g(p) - g(x)), g(z) = i (1 + z) / (1 - z), h(w) = (w - i) / (w + i), of points turned by the angle of y."""
    return f"""e AS (SELECT path_id, arg_min(x, idx) AS fx, arg_min(y, idx) AS fy, atan2(arg_max(y, idx), arg_max(x, idx)) * {turn} AS c FROM s GROUP BY path_id),
r AS (SELECT path_id, idx, x * cos(c) - y * sin(c) AS x, x * sin(c) + y * cos(c) AS y, fx * cos(c) - fy * sin(c) AS fx, fx * sin(c) + fy * cos(c) AS fy FROM s JOIN e USING (path_id)),
w AS (SELECT path_id, idx, -2 * y / ((1 - x) * (1 - x) + y * y) + 2 * fy / ((1 - fx) * (1 - fx) + fy * fy) AS a, (1 - x * x - y * y) / ((1 - x) * (1 - x) + y * y) - (1 - fx * fx - fy * fy) / ((1 - fx) * (1 - fx) + fy * fy) AS b FROM r WHERE idx < 12)
SELECT path_id, idx, round((a * a + b * b - 1) / (a * a + (b + 1) * (b + 1)), 6) + 0.0::DOUBLE AS x, round(-2 * a / (a * a + (b + 1) * (b + 1)), 6) + 0.0::DOUBLE AS y FROM w UNION ALL SELECT path_id, 12, 1.0, 0.0 FROM e"""


def _spirals(spark: SparkSession) -> DataFrame:
    s = spark.range(78).select(F.expr("id div 13").alias("path_id"), F.expr("id % 13").alias("idx"))
    radius, angle = 1 - F.sin(F.pi() * F.col("idx") / 12) * 0.8, F.col("path_id") + F.lit(2.0) + F.col("idx") * 0.31
    return s.select("path_id", "idx", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("path_id", "idx", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@R.add("aligned_paths", f"WITH {_SPIRAL}, {_aligned(1)}")
def aligned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(estimate.align_paths(_spirals(spark)))


@R.add("aligned_paths_back", f"WITH {_SPIRAL}, {_aligned(-1)}")
def aligned_paths_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(estimate.align_paths(_spirals(spark), -1))


@R.add("rotated_points", "SELECT c_custkey, round((a * c - b * d) / sqrt(c * c + d * d), 6) AS re, round((a * d + b * c) / sqrt(c * c + d * d), 6) AS im FROM (SELECT c_custkey, c_acctbal::DOUBLE / 1000 AS a, c_nationkey::DOUBLE AS b, c_nationkey::DOUBLE + 1 AS c, (c_custkey % 7)::DOUBLE AS d FROM customer)")
def rotated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer")
    z = estimate.rotate(pair(F.col("c_acctbal").cast("double") / 1000, F.col("c_nationkey")), pair(F.col("c_nationkey") + 1, F.col("c_custkey") % 7))
    return c.select("c_custkey", z.alias("z")).select("c_custkey", F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"))


_ENDPOINTS = "s AS (SELECT o_custkey AS series_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey % 3 AS ax, o_orderkey // 3 % 3 AS ay, o_orderkey // 9 % 3 AS bx, o_orderkey // 27 % 3 AS \"by\" FROM orders)"


@R.add("oriented_pairs", f"""WITH RECURSIVE {_ENDPOINTS}, r AS (SELECT * FROM s WHERE pos = 1 UNION ALL SELECT s.series_id, s.pos, CASE WHEN turn THEN s.bx ELSE s.ax END, CASE WHEN turn THEN s."by" ELSE s.ay END, CASE WHEN turn THEN s.ax ELSE s.bx END, CASE WHEN turn THEN s.ay ELSE s."by" END
FROM (SELECT s.*, (s.bx - r.ax) * (s.bx - r.ax) + (s."by" - r.ay) * (s."by" - r.ay) <= 1 AS turn FROM r JOIN s ON s.series_id = r.series_id AND s.pos = r.pos + 1) s) SELECT series_id, pos, ax, ay, bx, "by" FROM r""")
def oriented_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = lambda k: F.expr(f"o_orderkey div {3**k} % 3")
    o = t(spark, sf_dir, "orders").selectExpr("o_custkey AS series_id", "o_orderkey", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos")
    return statistics.oriented_pairs(o.select("series_id", F.col("pos").cast("long").alias("pos"), digit(0).alias("ax"), digit(1).alias("ay"), digit(2).alias("bx"), digit(3).alias("by")))


@R.add("block_cuts", f"WITH {_PLANS} SELECT plan_id AS block_id, CAST(count(*) AS DOUBLE) * count(*) AS value FROM cut GROUP BY plan_id")
def block_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _plans(spark)
    return statistics.block_cut(p.where("district = 1").select(F.col("plan_id").alias("block_id"), "node_id"), g.edges, 2)


@R.add("first_plans", f"WITH {grid_sql(10, 10)} SELECT node_id, CASE WHEN node_id = 0 THEN -1 ELSE 1 END AS all_but_first, CASE WHEN y < 4.5 THEN -1 ELSE 1 END AS low, CASE WHEN x > 5 THEN 1 ELSE -1 END AS wide, CASE WHEN x BETWEEN 2 AND 8 AND y BETWEEN 2 AND 8 THEN 0 ELSE 1 END AS vote, CASE WHEN y < 5 THEN 0 ELSE 1 END AS half FROM nodes")
def first_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = generators.lattice(spark, 10, 10).nodes
    out = plans.all_but_first(n).withColumnRenamed("district", "all_but_first")
    out = out.join(plans.split_at(n, F.col("y"), 4.5).withColumnRenamed("district", "low"), "node_id")
    out = out.join(plans.split_at(n, F.col("x"), 5, above=True).withColumnRenamed("district", "wide"), "node_id")
    return out.join(plans.middle_box(n, 10).withColumnRenamed("district", "half"), "node_id")


@R.add("class_totals", "SELECT feature, quality::VARCHAR AS y, count(value) AS n FROM (SELECT quality, unnest(['lang', 'source']) AS feature, unnest([lang, source]) AS value FROM documents JOIN labels USING (doc_id)) GROUP BY feature, quality")
def class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id")
    return learn.class_totals(learn.long_form(rows, "doc_id", ["lang", "source"], "quality"))


@R.add("restored_order", "SELECT c_custkey AS row_id, (row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1) * 3 AS value FROM customer")
def restored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("fold"))
    return learn.restored_order(spark.range(fold.count()).select(F.col("id").alias("i"), (F.col("id") * 3).alias("value")), fold)


@R.add("chain_edge_toggles")
def chain_edge_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = spark.range(4).select(F.col("id").alias("chain_id"), (F.lit(0.1) * (F.col("id") + 1)).alias("temperature"), F.lit(1.0).alias("fugacity"), (F.col("id") + 11).alias("seed"))
    trace = chains.edge_toggles(specs, generators.lattice(spark, 6, 6).edges, 4000)
    return trace.groupBy("chain_id").agg(F.avg("n_cut").alias("mean_cut"), F.avg("n_contradictions").alias("mean_contradictions"), F.count_if("accepted").alias("n_accepted"))
