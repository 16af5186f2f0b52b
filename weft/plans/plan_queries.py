"""Queries on predicates and scores of plans, blocks and paths, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import connect, enumerate, generators, plans
from .graph_queries import _FLATS, _PLANS, _WALK, _paths, _plans, grid_sql, numbered, unit_sql
from .registry import Registry

R = Registry()


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@R.add("plan_boundary_mixed", f"WITH {_PLANS} SELECT plan_id, count(DISTINCT district) > 1 AS mixed FROM plan WHERE x IN (0, 5) OR y IN (0, 5) GROUP BY plan_id")
def plan_boundary_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _plans(spark)
    return plans.boundary_mixed(p, g.nodes, 6, 6)


@R.add("plan_corners_apart", f"WITH {_PLANS} SELECT a.plan_id, a.district <> b.district AS apart FROM plan a JOIN plan b ON a.plan_id = b.plan_id WHERE a.node_id = 0 AND b.node_id = 30")
def plan_corners_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.apart(_plans(spark)[1], 0, 30)


@R.add("plan_valid_blocks", "SELECT CAST(i AS BIGINT) AS plan_id, i IN (0, 3) AS valid FROM range(4) t(i)")
def plan_valid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _plans(spark)
    return plans.valid_blocks(p, g.edges)


@R.add("plan_leaving_edges", f"WITH {_PLANS} SELECT plan_id, count(*) AS n, CAST(sum(s * s % 7) AS BIGINT) AS score FROM (SELECT plan_id, CASE WHEN du = 1 THEN u ELSE v END AS s FROM cut) GROUP BY plan_id")
def plan_leaving_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _plans(spark)
    return plans.leaving_edges(p, g.edges, g.nodes.select("node_id", F.expr("node_id * node_id % 7").alias("score")))


@R.add("plan_heavier_sides", f"WITH {_PLANS} SELECT plan_id, CAST(sign(sum(2 * district - 1)) AS INTEGER) AS side FROM plan GROUP BY plan_id")
def plan_heavier_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.heavier_side(_plans(spark)[1])


@R.add("cut_acceptance", "SELECT a.i AS cut, b.i AS parent, round(least(1.0, pow(1.6::DOUBLE, b.i - a.i)), 9) AS p FROM range(5, 12) a(i), range(5, 12) b(i)")
def cut_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.range(49).select(F.expr("id div 7 + 5").alias("cut"), F.expr("id % 7 + 5").alias("parent"))
    return r.withColumn("p", F.round(plans.acceptance(F.col("cut"), F.col("parent"), F.lit(1.6)), 9))


@R.add("paths_in_disc", f"WITH p AS ({_WALK}) SELECT path_id, bool_or(pow(x - 12, 2) + pow(y - 2, 2) <= 9) AS hit FROM p GROUP BY path_id")
def paths_in_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.hits_disc(_paths(spark), 12.0, 2.0, 3.0)


@R.add("order_likelihoods", "SELECT l_orderkey AS sample_id, round(1 / product(CAST(l_quantity AS DOUBLE)), 12) AS likelihood FROM lineitem GROUP BY ALL")
def order_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_quantity").alias("degree"))
    return plans.likelihood(steps).withColumn("likelihood", F.round("likelihood", 12))


_LEVELS = "SELECT b.i % 4 AS level, b.i * 0.05::DOUBLE AS lo, b.i * 0.05::DOUBLE + 0.02 * (b.i % 5) AS hi FROM range(20) b(i)"


@R.add("containing_levels", f"WITH v AS ({_LEVELS}) SELECT p.i / 64.0::DOUBLE AS t, (SELECT count(DISTINCT level) FROM v WHERE lo <= p.i / 64.0::DOUBLE AND p.i / 64.0::DOUBLE <= hi) / 4.0::DOUBLE AS share FROM range(64) p(i)")
def containing_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.range(20).select(F.expr("id % 4").alias("level"), (F.col("id") * 0.05).alias("lo"), (F.col("id") * 0.05 + F.lit(0.02) * F.expr("id % 5")).alias("hi"))
    return plans.containing_levels(v, spark.range(64).select((F.col("id") / F.lit(64.0)).alias("t")), 4)


@R.add("confusion_counts", "WITH s AS (SELECT CAST(doc_id * 37 % 101 AS DOUBLE) / 101 AS score, quality AS label FROM labels) SELECT count(*) FILTER (score >= 0.4 AND label = 1) AS tp, count(*) FILTER (score >= 0.4 AND label <> 1) AS fp, count(*) FILTER (score < 0.4 AND label = 1) AS fn, count(*) FILTER (score < 0.4 AND label <> 1) AS tn, round(count(*) FILTER ((score >= 0.4) <> (label = 1)) / count(*), 9) AS error FROM s")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "labels").select(((F.col("doc_id") * 37 % 101).cast("double") / 101).alias("score"), F.col("quality").alias("label"))
    return plans.confusion(s, 0.4).withColumn("error", F.round("error", 9))


@R.add("random_monomials", f"SELECT term, CAST(sum(1::BIGINT << k) AS BIGINT) AS mask FROM (SELECT a.i AS term, CAST(b.i AS INTEGER) AS k, row_number() OVER (PARTITION BY a.i ORDER BY {unit_sql('31', 'a.i', 'b.i')}, b.i) AS r FROM range(30) a(i), range(10) b(i)) WHERE r <= 4 GROUP BY term")
def random_monomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.random_monomials(spark, 10, 30, 4, 31)


@R.add("simple_cycles_3x3", f"WITH RECURSIVE {grid_sql(3, 3)}{_FLATS}, deg AS (SELECT mask, n, count(*) AS d FROM (SELECT mask, u AS n FROM kept UNION ALL SELECT mask, v FROM kept) GROUP BY ALL), c AS (SELECT d.mask, min(d) AS lo, max(d) AS hi, count(DISTINCT comp) AS k, count(*) AS len FROM deg d JOIN comp ON comp.mask = d.mask AND comp.node_id = d.n GROUP BY d.mask) SELECT len AS length, count(*) AS n FROM c WHERE lo = 2 AND hi = 2 AND k = 1 GROUP BY len")
def simple_cycles_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = enumerate.edge_subsets(numbered(generators.lattice(spark, 3, 3)), 12).where("kept").select(F.col("mask").alias("key"), "u", "v")
    cycles = connect.simple_cycle(kept).where("is_cycle").select("key")
    return kept.join(cycles, "key", "left_semi").groupBy("key").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("n"))
