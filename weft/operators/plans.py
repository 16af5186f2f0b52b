"""Predicates and scores of plans, blocks, paths and importance samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import random_unit
from .connect import block_components


def boundary_mixed(plan: DataFrame, nodes: DataFrame, width: int, height: int) -> DataFrame:
    """(plan_id, mixed): whether the outer nodes of a grid are in more than one district."""
    outer = nodes.where(f"x IN (0, {width - 1}) OR y IN (0, {height - 1})").select("node_id")
    m = plan.join(F.broadcast(outer), "node_id").groupBy("plan_id").agg(F.min("district").alias("lo"), F.max("district").alias("hi"))
    return m.select("plan_id", (F.col("lo") < F.col("hi")).alias("mixed"))


def apart(plan: DataFrame, a: int, b: int) -> DataFrame:
    """(plan_id, apart): whether two nodes are in different districts."""
    of = lambda n: F.max(F.when(F.col("node_id") == n, F.col("district")))
    return plan.where(F.col("node_id").isin(a, b)).groupBy("plan_id").agg((of(a) != of(b)).alias("apart"))


def valid_blocks(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, valid): whether every district, a block and its complement say, is connected."""
    return block_components(plan, edges).groupBy("plan_id").agg((F.max("n_components") == 1).alias("valid"))


def leaving_edges(plan: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(plan_id, n, score): edges from district 1 to elsewhere and the sum over them of their inner ends' scores(node_id, score)."""
    u = plan.select("plan_id", F.col("node_id").alias("u"), F.col("district").alias("du"))
    v = plan.select("plan_id", F.col("node_id").alias("v"), F.col("district").alias("dv"))
    out = edges.join(u, "u").join(v, ["plan_id", "v"]).where("(du = 1) <> (dv = 1)").select("plan_id", F.when(F.col("du") == 1, F.col("u")).otherwise(F.col("v")).alias("node_id"))
    return out.join(scores, "node_id").groupBy("plan_id").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("score"))


def heavier_side(plan: DataFrame) -> DataFrame:
    """(plan_id, side): the sign of the nodes in district 1 less the others."""
    return plan.groupBy("plan_id").agg(F.signum(F.sum(F.when(F.col("district") == 1, 1).otherwise(-1))).cast("int").alias("side"))


def acceptance(cut: Column, parent: Column, base: Column) -> Column:
    """base ** (parent - cut), 1 at most."""
    return F.least(F.lit(1.0), F.pow(base, parent - cut))


def hits_disc(path: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """(path_id, hit): whether some point of path(path_id, x, y) is within a disc."""
    near = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) <= radius * radius
    return path.groupBy("path_id").agg(F.bool_or(near).alias("hit"))


def likelihood(steps: DataFrame) -> DataFrame:
    """(sample_id, likelihood): one over the product of the degrees of steps(sample_id, degree)."""
    return steps.groupBy("sample_id").agg(F.exp(-F.sum(F.log("degree"))).alias("likelihood"))


def containing_levels(intervals: DataFrame, points: DataFrame, levels: int) -> DataFrame:
    """(t, share): of intervals(level, lo, hi), the share of levels of which one contains t, by sorted ends and running sums, not a range join."""
    ends = intervals.select("level", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("step")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("step")))).alias("e")).select("level", "e.at", "e.step")
    from pyspark.sql import Window

    every = points.select(F.col("t").alias("at")).crossJoin(F.broadcast(intervals.select("level").distinct())).select("level", "at", F.lit(0).alias("step"))
    # At one place starts come first, then points, then ends: intervals hold their ends.
    w = Window.partitionBy("level").orderBy("at", F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    open_ = ends.union(every).withColumn("n", F.sum("step").over(w)).where("step = 0")
    return open_.groupBy(F.col("at").alias("t")).agg((F.count_if(F.col("n") > 0) / levels).alias("share"))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: tp, fp, fn, tn and error of scored(score, label 0/1)."""
    yes, pos = F.col("score") >= threshold, F.col("label") == 1
    counts = [F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(~yes & ~pos).alias("tn")]
    return scored.agg(*counts).withColumn("error", (F.col("fp") + F.col("fn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def random_monomials(spark: SparkSession, n: int, m: int, d: int, seed: int = 1) -> DataFrame:
    """(term, mask): m random monomials of degree d in n variables: those of the d least draws."""
    from pyspark.sql import Window

    rows = spark.range(m * n).select(F.expr(f"id div {n}").alias("term"), F.expr(f"cast(id % {n} as int)").alias("k"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(random_unit(seed, F.col("term"), F.col("k")), "k"))).where(F.col("r") <= d)
    return rows.groupBy("term").agg(F.sum(F.expr("1L << k")).cast("long").alias("mask"))


# First plans of chains, and votes, as (node_id, ..) of nodes(node_id, x, y, ..).


def all_but_first(nodes: DataFrame) -> DataFrame:
    """District 1, but for the least node, which is in -1."""
    return nodes.join(nodes.agg(F.min("node_id").alias("_least"))).select("node_id", F.when(F.col("node_id") == F.col("_least"), -1).otherwise(1).alias("district"))


def split_at(nodes: DataFrame, value: Column, limit: float, above: bool = False) -> DataFrame:
    """District 1 where value is ``limit`` or more, -1 below; with ``above`` 1 only over it."""
    return nodes.select("node_id", F.when(value > limit if above else value >= limit, 1).otherwise(-1).alias("district"))


def middle_box(nodes: DataFrame, size: int, p: float = 0.2, q: float = 0.2 + 0.4**0.5) -> DataFrame:
    """(node_id, vote, district) of a grid: vote 0 where both coordinates are from p * size to below q * size, else 1; district 0 in the lower half."""
    inside = lambda c: (F.col(c) >= p * size) & (F.col(c) < q * size)
    return nodes.select("node_id", F.when(inside("x") & inside("y"), 0).otherwise(1).alias("vote"), F.when(F.col("y") < size / 2, 0).otherwise(1).alias("district"))


def straight_path(spark: SparkSession, x: int, y: int, to_x: int) -> DataFrame:
    """(pos, x, y): the path to the right from (x, y) to (to_x, y)."""
    return spark.range(to_x - x + 1).select(F.col("id").alias("pos"), (F.col("id") + x).alias("x"), F.lit(y).cast("long").alias("y"))
