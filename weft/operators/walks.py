"""Random walks of a graph until they have seen enough, the trees of their first entrances, and small cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import P


def draw_int(seed: int, step: int, k: int) -> int:
    """random_int() of functions.portable, for what is sequential by nature."""
    r = pow((seed * 48271 + step * 69621 + k * 16807 + 12345) % P, 5, P)
    return pow((r * 48271 + 11) % P, 5, P)


def adjacency(edges: DataFrame, max_edges: int = 1 << 16) -> dict[int, list[int]]:
    """Sorted neighbours by node, of edges(u, v), for what walks on a small graph; a ValueError beyond ``max_edges``."""
    rows = edges.select("u", "v").limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"over {max_edges} edges")
    near: dict[int, set[int]] = {}
    for r in rows:
        near.setdefault(int(r.u), set()).add(int(r.v))
        near.setdefault(int(r.v), set()).add(int(r.u))
    return {k: sorted(v) for k, v in near.items()}


def covering_walks(starts: DataFrame, edges: DataFrame, n_distinct: int, seed: int = 1) -> DataFrame:
    """(walk_id, idx, node_id): simple random walks from starts(walk_id, node_id) until they have met ``n_distinct`` nodes. A walk is sequential; walks are spread
    over the cluster. From a node whose component has fewer nodes the call fails."""
    near = adjacency(edges)
    size: dict[int, int] = {}
    for k in near:
        if k not in size:
            part, todo = {k}, [k]
            while todo:
                for x in near[todo.pop()]:
                    if x not in part:
                        part.add(x)
                        todo.append(x)
            size |= dict.fromkeys(part, len(part))
    shared = starts.sparkSession.sparkContext.broadcast((near, size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, size = shared.value
        for pdf in batches:
            for walk, node in zip(pdf["walk_id"].tolist(), pdf["node_id"].tolist(), strict=True):
                if size.get(node, 1) < n_distinct:
                    raise ValueError(f"the component of {node} has fewer than {n_distinct} nodes")
                path, seen = [node], {node}
                while len(seen) < n_distinct:
                    node = near[node][draw_int(seed, walk, len(path)) % len(near[node])]
                    path.append(node)
                    seen.add(node)
                yield pd.DataFrame({"walk_id": walk, "idx": range(len(path)), "node_id": path})

    return starts.select(F.col("walk_id").cast("long"), F.col("node_id").cast("long")).mapInPandas(run, "walk_id long, idx long, node_id long")


def first_entrances(walks: DataFrame) -> DataFrame:
    """(walk_id, u, v): of walks(walk_id, idx, node_id), the edge by which each node but the first is entered first, a tree."""
    w = Window.partitionBy("walk_id").orderBy("idx")
    steps = walks.withColumn("u", F.lag("node_id").over(w)).withColumn("k", F.row_number().over(Window.partitionBy("walk_id", "node_id").orderBy("idx")))
    return steps.where("k = 1 AND u IS NOT NULL").select("walk_id", "u", F.col("node_id").alias("v"))


def supernode(edges: DataFrame) -> DataFrame:
    """(node_id, degree) of one row: the node of most edges, the least of several."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return ends.agg(F.max(F.struct("degree", (-F.col("node_id")).alias("k"))).alias("m")).where("m IS NOT NULL").select((-F.col("m.k")).alias("node_id"), F.col("m.degree").alias("degree"))


def cycle_edges(edges: DataFrame) -> DataFrame:
    """The edges of edges(u, v) that are left when leaves are cut off again and again: of a graph with one cycle, that cycle. Each round's table is checkpointed."""
    left = edges.select("u", "v").checkpoint()
    n = left.count()
    while True:
        ends = left.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("k")).where("k = 1").select("node_id")
        left = left.join(ends.withColumnRenamed("node_id", "u"), "u", "left_anti").join(ends.withColumnRenamed("node_id", "v"), "v", "left_anti").select("u", "v").checkpoint()
        if (m := left.count()) == n:
            return left
        n = m
