"""Queries on sets, paths, permutations and node scores, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import combinatorics, generators, planar, sets, statistics
from .graph_queries import _PLANS, _plans, grid_sql
from .registry import Registry

R = Registry()


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@R.add("symmetric_difference", "(SELECT l_partkey AS k FROM lineitem EXCEPT SELECT c_custkey FROM customer) UNION (SELECT c_custkey FROM customer EXCEPT SELECT l_partkey FROM lineitem)")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.symmetric_difference(t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@R.add("monomials", "SELECT i AS mask FROM range(128) t(i) WHERE bit_count(i) = 3")
def monomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.subsets_of_size(spark, 7, 3)


@R.add("bit_strings", "SELECT i AS mask, lpad(bin(i), 6, '0') AS bits FROM range(64) t(i)")
def bit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.bit_strings(spark, 6)


@R.add("order_paths", "SELECT * FROM (SELECT o_custkey AS path_id, o_orderkey AS pos, o_orderkey AS u, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders) WHERE v IS NOT NULL")
def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.path_edges(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("node_id")))


@R.add("edge_weights", f"WITH {grid_sql(4, 3)} SELECT u, v, CAST((1 << u) + (1 << v) AS BIGINT) AS weight FROM edges")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generators.lattice(spark, 4, 3)
    return sets.edge_weights(g.edges, g.nodes.select("node_id", F.expr("1L << cast(node_id as int)").alias("weight")))


_PERM = "(SELECT p AS perm_id, i, (i * (2 * p + 1) + p) % 32 AS image FROM range(5) a(p), range(32) b(i))"


@R.add("inverse_permutations", f"SELECT perm_id, image AS i, i AS image FROM {_PERM}")
def inverse_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.inverse(_permutations(spark))


def _permutations(spark: SparkSession) -> DataFrame:
    return spark.range(160).select(F.expr("id div 32").alias("perm_id"), F.expr("id % 32").alias("i")).withColumn("image", F.expr("(i * (2 * perm_id + 1) + perm_id) % 32"))


@R.add("reordered_rows", f"SELECT perm_id, i, image * image AS v FROM {_PERM}")
def reordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.reorder(spark.range(32).select(F.col("id").alias("i"), (F.col("id") * F.col("id")).alias("v")), _permutations(spark))


@R.add("tree_scores", """
WITH RECURSIVE t AS (SELECT 0::BIGINT AS heap, 0 AS level UNION ALL SELECT 2 * heap + c, level + 1 FROM t, (VALUES (1), (2)) b(c) WHERE level < 3),
n AS (SELECT heap AS node_id, level, CASE WHEN level = 3 THEN 0 ELSE 1 END AS half FROM t UNION ALL SELECT 15 + heap, level, -1 FROM t WHERE level < 3),
m AS (SELECT s AS set_id, n.* FROM range(1, 8) r(s), n WHERE node_id % s = 0)
SELECT set_id, CAST(sum(level) AS BIGINT) AS depth_weighted, CAST(sum(CAST(level = 3 AS INT)) AS BIGINT) AS middle, CAST(sum(half) AS BIGINT) AS balance, CAST(sum(half * power(10, 3 - level)) AS BIGINT) AS weighted_balance, CAST(sum(CASE WHEN level = 0 THEN CASE WHEN half = 1 THEN 1 ELSE -10 END ELSE 0 END) AS BIGINT) AS roots FROM m GROUP BY set_id""")
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = generators.doubled_tree(spark, 2, 3).nodes
    members = spark.range(1, 8).select(F.col("id").alias("set_id")).crossJoin(nodes.select("node_id")).where("node_id % set_id = 0")
    return sets.tree_scores(members, nodes, 3)


@R.add("points_in_box", "SELECT label, round(avg(CAST(embedding[1] * 8 - floor(embedding[1] * 8) <= 0.75 AND embedding[2] * 8 - floor(embedding[2] * 8) <= 0.75 AS INT)), 9) AS share FROM embeddings GROUP BY label")
def points_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = t(spark, sf_dir, "embeddings").select("label", F.transform(F.slice("embedding", 1, 2), lambda x: x * F.lit(8).cast("float")).alias("p"))
    return sets.in_box(points, "label", "p", 0.75).withColumn("share", F.round("share", 9))


@R.add("covering_map", "SELECT CAST(((a.i - 9) % 5 + 5) % 5 AS BIGINT) AS x, CAST(((b.i - 9) % 5 + 5) % 5 AS BIGINT) AS y, count(*) AS n FROM range(19) a(i), range(19) b(i) GROUP BY ALL")
def covering_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.range(361).select(F.expr("id div 19 - 9").alias("x"), F.expr("id % 19 - 9").alias("y"))
    return sets.covering_map(points, 5).groupBy("x", "y").agg(F.count("*").alias("n"))


@R.add("north_west_cells", "WITH c AS (SELECT s AS set_id, i % 7 AS x, i // 7 AS y FROM range(1, 9) a(s), range(49) b(i) WHERE i * i % (s + 3) < 3) SELECT set_id, min(x) AS x, y FROM c WHERE y = (SELECT max(y) FROM c d WHERE d.set_id = c.set_id) GROUP BY set_id, y")
def north_west_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.range(1, 9).select(F.col("id").alias("set_id")).crossJoin(spark.range(49).withColumnRenamed("id", "i")).where("i * i % (set_id + 3) < 3").select("set_id", F.expr("i % 7").alias("x"), F.expr("i div 7").alias("y"))
    return sets.north_west(cells)


@R.add("shortest_paths", f"WITH RECURSIVE {grid_sql(4, 4)}, w AS (SELECT u, v, (u * 7 + v * 3) % 11 + 1 AS weight FROM edges), half AS (SELECT u AS a, v AS b, weight FROM w UNION ALL SELECT v, u, weight FROM w), p AS (SELECT 0::BIGINT AS n, 0::BIGINT AS dist, [0::BIGINT] AS seen UNION ALL SELECT b, dist + weight, list_append(seen, b) FROM p JOIN half ON a = n WHERE NOT list_contains(seen, b)) SELECT n AS node_id, min(dist) AS dist FROM p GROUP BY n")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = generators.lattice(spark, 4, 4).edges.withColumn("weight", F.expr("(u * 7 + v * 3) % 11 + 1"))
    return sets.shortest_paths(e, 0, 16)


@R.add("contiguous_chunks", "SELECT o_orderkey, CAST(least(6, (row_number() OVER (ORDER BY o_orderkey) - 1) // greatest(1, (SELECT count(*) FROM orders) // 7)) AS INTEGER) AS chunk FROM orders")
def contiguous_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.contiguous_chunks(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


@R.add("plan_side_counts", f'WITH {_PLANS} SELECT plan_id, count(*) FILTER (ux = 0 AND vx = 0) AS "left", count(*) FILTER (ux = 5 AND vx = 5) AS "right", count(*) FILTER (uy = 0 AND vy = 0) AS bottom, count(*) FILTER (uy = 5 AND vy = 5) AS top FROM cut GROUP BY plan_id')
def plan_side_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, plans = _plans(spark)
    return sets.side_counts(statistics.cut_edges(plans, g.edges), g.nodes, 6)


@R.add("average_curves", "SELECT l_linenumber AS t, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL")
def average_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.average_curves(t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("curve_id"), F.col("l_linenumber").alias("t"), F.col("l_quantity").alias("v"))).withColumn("v", F.round("v", 6))


@R.add("dual_distances", "SELECT CAST(greatest(a.i, b.i) AS INTEGER) AS d, count(*) AS n FROM range(4) a(i), range(4) b(i) WHERE false GROUP BY ALL UNION ALL SELECT CAST(k AS INTEGER), n FROM (VALUES (0, 1), (1, 2), (2, 3), (3, 2), (4, 1)) v(k, n)")
def dual_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = planar.dual(generators.lattice(spark, 4, 4)).select("a", "b")
    first = e.select(F.least(F.min("a"), F.min("b")).alias("face"))
    return sets.dual_distance(e, first, 10).groupBy(F.col("dist").cast("int").alias("d")).agg(F.count("*").alias("n"))


@R.add("central_binomials", "WITH RECURSIVE c(m, c) AS (SELECT 0, 1::HUGEINT UNION ALL SELECT m + 1, c * (4 * (m + 1) - 2) // (m + 1) FROM c WHERE m < 30) SELECT m, CAST(c AS DECIMAL(38,0)) AS c FROM c")
def central_binomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combinatorics.central_binomials(spark, 30)
