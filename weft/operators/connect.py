"""Components, partitions and predicates on them; everything is keyed, so that many graphs are worked on at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., node_id, comp): the least node reachable, of nodes(keys.., node_id) and edges(keys.., u, v), by rounds of least
    neighbours and pointer jumping; the number of rounds grows with the logarithm of the longest path in practice."""
    k = list(keys)
    both = edges.select(*k, F.col("u").alias("node_id"), F.col("v").alias("other")).union(edges.select(*k, "v", "u")).distinct().checkpoint()
    labels = nodes.select(*k, "node_id").distinct().withColumn("comp", F.col("node_id")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node_id", "other"), [*k, "other"]).groupBy(*k, "node_id").agg(F.min("comp").alias("near"))
        lower = labels.join(near, [*k, "node_id"], "left").select(*k, "node_id", F.least("comp", F.coalesce("near", "comp")).alias("low"), F.col("comp").alias("was"))
        jump = labels.select(*k, F.col("node_id").alias("low"), F.col("comp").alias("far"))
        step = lower.join(jump, [*k, "low"]).select(*k, "node_id", F.least("low", "far").alias("comp"), "was").checkpoint()
        labels = step.select(*k, "node_id", "comp")
        if not step.where("comp <> was").limit(1).count():
            return labels


def block_components(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, district, n_components): into how many pieces each district of plan(plan_id, node_id, district) falls in the graph."""
    u = plan.select("plan_id", F.col("node_id").alias("u"), F.col("district").alias("du"))
    v = plan.select("plan_id", F.col("node_id").alias("v"), F.col("district").alias("dv"))
    inner = edges.join(u, "u").join(v, ["plan_id", "v"]).where("du = dv").select("plan_id", "u", "v")
    comp = components(plan, inner, ("plan_id",)).join(plan, ["plan_id", "node_id"])
    return comp.groupBy("plan_id", "district").agg(F.countDistinct("comp").alias("n_components"))


def contradictions(labels: DataFrame, cut: DataFrame) -> DataFrame:
    """Cut edges(u, v) whose ends have the same label in labels(node_id, comp)."""
    a, b = labels.select(F.col("node_id").alias("u"), F.col("comp").alias("cu")), labels.select(F.col("node_id").alias("v"), F.col("comp").alias("cv"))
    return cut.join(a, "u").join(b, "v").where("cu = cv").select("u", "v")


def closure(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The flat spanned by the chosen edges: all edges within their components."""
    return contradictions(components(nodes, chosen), edges)


def rank(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: rank of the chosen edges (nodes less components), their number, and whether they are a forest."""
    comp = components(nodes, chosen).agg(F.count("*").alias("n"), F.countDistinct("comp").alias("c")).select((F.col("n") - F.col("c")).alias("rank"))
    return comp.crossJoin(chosen.agg(F.count("*").alias("n_edges"))).select("rank", "n_edges", (F.col("rank") == F.col("n_edges")).alias("forest"))


def self_avoiding(path: DataFrame) -> DataFrame:
    """(path_id, self_avoiding, n_double_back) of path(path_id, pos, x, y): no point twice; pairs of points one step or less apart that aren't neighbours on the path."""
    a, b = path.alias("a"), path.alias("b")
    close = a.join(b, F.expr("a.path_id = b.path_id AND a.pos + 1 < b.pos AND abs(a.x - b.x) + abs(a.y - b.y) <= 1")).groupBy("a.path_id").agg(F.count("*").alias("n"))
    own = path.groupBy("path_id").agg((F.count("*") == F.countDistinct("x", "y")).alias("self_avoiding"))
    return own.join(close, "path_id", "left").select("path_id", "self_avoiding", F.coalesce("n", F.lit(0)).cast("long").alias("n_double_back"))


def simple_cycle(edges: DataFrame) -> DataFrame:
    """(key, is_cycle) of edges(key, u, v): every node has degree 2 and there is one component."""
    ends = edges.select("key", F.explode(F.array("u", "v")).alias("node_id"))
    degree = ends.groupBy("key", "node_id").agg(F.count("*").alias("d")).groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    comp = components(ends, edges, ("key",)).groupBy("key").agg(F.countDistinct("comp").alias("c"))
    return degree.join(comp, "key").select("key", F.expr("lo = 2 AND hi = 2 AND c = 1").alias("is_cycle"))


def separating_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes whose removal leaves the rest in more than one piece. For small graphs: all pairs are tried."""
    ids = nodes.select("node_id")
    pairs = ids.select(F.col("node_id").alias("a")).join(ids.select(F.col("node_id").alias("b")), F.expr("a < b"))
    rest = pairs.join(ids, F.expr("node_id <> a AND node_id <> b"))
    kept = pairs.join(edges.select("u", "v"), F.expr("u <> a AND u <> b AND v <> a AND v <> b"))
    return components(rest, kept, ("a", "b")).groupBy("a", "b").agg(F.countDistinct("comp").alias("c")).where("c > 1").select("a", "b")
