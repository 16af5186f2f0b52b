"""Scores of the boundary of an m x m box, and what blocks and endpoints of interfaces score by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boundary_scores(nodes: DataFrame, m: int) -> DataFrame:
    """node_id, x, y of the boundary nodes of nodes(node_id, x, y) with their scores: ``plain`` (1 for each upright side that a node is on, -1 for each level one), ``re`` and
    ``im`` (1, -1 for left and right, i and -i for bottom and top), and the four damped by a bell curve around the middle of the side."""
    side = lambda c, k: F.when(F.col(c) == k, 1.0).otherwise(0.0)
    left, right, bottom, top = side("x", 0), side("x", m - 1), side("y", 0), side("y", m - 1)
    bell = lambda c: F.exp(-(F.col(c) - m / 2) * (F.col(c) - m / 2) / F.lit(float(m)))
    upright, level = F.greatest(left, right), F.greatest(bottom, top)
    return nodes.where((upright > 0) | (level > 0)).select(
        "node_id", "x", "y", (upright - level).alias("plain"), (left - right).alias("re"), (bottom - top).alias("im"), (upright * bell("y") - level * bell("x")).alias("smooth"),
        ((left - right) * bell("x")).alias("smooth_re"), ((bottom - top) * bell("y")).alias("smooth_im"),
    )


def restrict(blocks: DataFrame, boundary: DataFrame) -> DataFrame:
    """The rows of blocks(..., node_id) whose node is one of boundary(node_id)."""
    return blocks.join(boundary.select("node_id"), "node_id", "left_semi").select(*blocks.columns)


def block_score(blocks: DataFrame, scores: DataFrame, *score: str) -> DataFrame:
    """Of each block_id of blocks(block_id, node_id), the sums of the named scores over its nodes; nodes without scores count 0."""
    both = blocks.join(scores.select("node_id", *score), "node_id", "left")
    return both.groupBy("block_id").agg(*[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in score])


def endpoint_score(ends: DataFrame, scores: DataFrame, *score: str) -> DataFrame:
    """Of each block_id of ends(block_id, u, v), edges at which an interface leaves the box, the sums of the named scores over both ends of all edges."""
    return block_score(ends.select("block_id", F.explode(F.array("u", "v")).alias("node_id")), scores, *score)


def midpoints(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """block_id, u, v and the middle (x, y) of each edge of ends(block_id, u, v)."""
    a, b = (nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}")) for k in "uv")
    return ends.join(a, "u").join(b, "v").select("block_id", "u", "v", ((F.col("x_u") + F.col("x_v")) / 2).alias("x"), ((F.col("y_u") + F.col("y_v")) / 2).alias("y"))
