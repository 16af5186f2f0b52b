"""Samplers over many samples at once: every draw is a function of (seed, sample, counter), so results repeat on any cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.portable import P, random_unit
from .connect import closure, components


def edge_subset_samples(spark: SparkSession, edges: DataFrame, samples: int, seed: int = 1, p: float = 0.5) -> DataFrame:
    """(sample_id, u, v, kept) of edges(edge_id, u, v): each kept with probability p."""
    ids = spark.range(samples).select(F.col("id").alias("sample_id"))
    return ids.crossJoin(F.broadcast(edges)).withColumn("kept", random_unit(seed, F.col("sample_id"), F.col("edge_id")) < p).select("sample_id", "u", "v", "kept")


def accepted_flats(nodes: DataFrame, drawn: DataFrame) -> DataFrame:
    """(sample_id, n_blocks, accepted) of drawn edge subsets: accepted if no dropped edge lies within a component of kept ones."""
    ids = drawn.select("sample_id").distinct()
    labels = components(ids.crossJoin(F.broadcast(nodes.select("node_id"))), drawn.where("kept").select("sample_id", "u", "v"), ("sample_id",))
    a, b = labels.select("sample_id", F.col("node_id").alias("u"), F.col("comp").alias("cu")), labels.select("sample_id", F.col("node_id").alias("v"), F.col("comp").alias("cv"))
    bad = drawn.where("NOT kept").join(a, ["sample_id", "u"]).join(b, ["sample_id", "v"]).where("cu = cv").groupBy("sample_id").agg(F.count("*").alias("bad"))
    blocks = labels.groupBy("sample_id").agg(F.countDistinct("comp").alias("n_blocks"))
    return blocks.join(bad, "sample_id", "left").select("sample_id", "n_blocks", F.col("bad").isNull().alias("accepted"))


def largest_block(labels: DataFrame) -> DataFrame:
    """(sample_id, size) of the largest component of labels(sample_id, node_id, comp)."""
    return labels.groupBy("sample_id", "comp").agg(F.count("*").alias("size")).groupBy("sample_id").agg(F.max("size").alias("size"))


def spanning_forest(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Least-weight spanning forests by Boruvka's rounds: (keys.., u, v, weight) of edges(keys.., u, v, weight), ties by (u, v)."""
    k = list(keys)
    edges = edges.select(*k, "u", "v", "weight").checkpoint()
    comp = nodes.select(*k, "node_id").distinct().withColumn("comp", F.col("node_id"))
    chosen = None
    while True:
        a, b = comp.select(*k, F.col("node_id").alias("u"), F.col("comp").alias("cu")), comp.select(*k, F.col("node_id").alias("v"), F.col("comp").alias("cv"))
        out = edges.join(a, [*k, "u"]).join(b, [*k, "v"]).where("cu <> cv")
        sides = out.select(*k, F.explode(F.array("cu", "cv")).alias("comp"), F.struct("weight", "u", "v").alias("e"))
        new = sides.groupBy(*k, "comp").agg(F.min("e").alias("e")).select(*k, "e.u", "e.v", "e.weight").distinct().checkpoint()
        if not new.limit(1).count():
            return chosen if chosen is not None else new
        chosen = new if chosen is None else chosen.union(new).distinct().checkpoint()
        comp = components(nodes, chosen, keys)


def random_forests(spark: SparkSession, nodes: DataFrame, edges: DataFrame, samples: int, seed: int = 1) -> DataFrame:
    """(sample_id, u, v, weight): least spanning trees of edges(edge_id, u, v) under independent uniform weights."""
    ids = spark.range(samples).select(F.col("id").alias("sample_id"))
    weighted = ids.crossJoin(F.broadcast(edges)).select("sample_id", "u", "v", random_unit(seed, F.col("sample_id"), F.col("edge_id")).alias("weight"))
    return spanning_forest(ids.crossJoin(F.broadcast(nodes.select("node_id"))), weighted, ("sample_id",))


def _draw(seed: int, step: int, k: int) -> float:
    fifth = lambda r: pow(r, 5, P)
    r = fifth((seed * 48271 + step * 69621 + k * 16807 + 12345) % P)
    return fifth((r * 48271 + 11) % P) / P


def wilson_trees(spark: SparkSession, edges: DataFrame, samples: int, seed: int = 1, max_edges: int = 1 << 16) -> DataFrame:
    """(sample_id, u, v): uniform spanning trees of a small graph by loop-erased walks. A walk is sequential: one sample is one
    group, and samples are spread over the cluster; edges(u, v) is broadcast. Beyond ``max_edges`` edges, and on a graph that
    isn't connected, where a walk would never end, the call fails."""
    half = [(int(r.u), int(r.v)) for r in edges.select("u", "v").limit(max_edges + 1).collect()]
    if len(half) > max_edges:
        raise ValueError(f"over {max_edges} edges")
    near: dict[int, list[int]] = {}
    for u, v in sorted(half):
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    reached = set(list(near)[:1])
    ahead = list(reached)
    while ahead:
        new = set(near[ahead.pop()]) - reached
        reached |= new
        ahead += new
    if len(reached) < len(near):
        raise ValueError("the graph isn't connected")
    shared = spark.sparkContext.broadcast({k: sorted(v) for k, v in near.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        order = sorted(graph)
        for pdf in batches:
            rows = []
            for s in pdf["sample_id"].tolist():
                inside, t = {order[0]}, 0
                for start in order:
                    step: dict[int, int] = {}
                    at = start
                    while at not in inside:
                        step[at] = graph[at][int(_draw(seed, s, t) * len(graph[at])) % len(graph[at])]
                        at, t = step[at], t + 1
                    at = start
                    while at not in inside:
                        inside.add(at)
                        rows.append((s, min(at, step[at]), max(at, step[at])))
                        at = step[at]
            yield pd.DataFrame(rows, columns=["sample_id", "u", "v"])

    return spark.range(samples).select(F.col("id").alias("sample_id")).mapInPandas(run, "sample_id long, u long, v long")


def min_unique(weights: DataFrame, family: DataFrame) -> DataFrame:
    """(family_id, least, n_least): over sets(family_id, set_id, item) weighed by weights(item, weight), the least weight and how many sets have it."""
    w = family.join(weights, "item").groupBy("family_id", "set_id").agg(F.sum("weight").cast("long").alias("weight"))
    return w.groupBy("family_id").agg(F.min("weight").alias("least"), F.min_by(F.lit(1), "weight").alias("_")).drop("_").join(w, "family_id").where("weight = least").groupBy("family_id", "least").agg(F.count("*").alias("n_least"))


def geometric(u, p):
    """Inverse distribution function of failures before the first success."""
    return F.floor(F.log1p(-u) / F.log1p(-p)).cast("long")


def hash_weights(nodes: DataFrame, prime: int, multipliers: list[int]) -> DataFrame:
    """nodes(layer, i, label) with weights by recursive hashing: round k adds (a_k * label mod prime) to the layers that are odd multiples of 2**k."""
    w = F.lit(0).cast("long")
    for k, a in enumerate(multipliers):
        w = w + F.when(F.expr(f"layer % {2 ** (k + 1)} = {2**k}"), F.col("label").cast("long") * a % prime).otherwise(0)
    return nodes.withColumn("weight", w)


def set_partitions(spark: SparkSession, n: int, samples: int, seed: int = 1) -> DataFrame:
    """(sample_id, item, urn): uniform set partitions by urns; the number of urns follows Dobinski's law, summed until its tail is below 2**-50."""
    terms, total, k, term = [], 0.0, 0, 0.0
    fact = 1.0
    for k in range(1, 60 + 2 * n):
        fact *= k
        term = k**n / fact
        terms.append(term)
        total += term
    limits = np.cumsum(terms) / total
    case = "CASE " + " ".join(f"WHEN u < {x!r}D THEN {i + 1}" for i, x in enumerate(limits[:-1].tolist())) + f" ELSE {len(limits)} END"
    urns = spark.range(samples).select(F.col("id").alias("sample_id")).withColumn("u", random_unit(seed, F.col("sample_id"), 0)).withColumn("urns", F.expr(case))
    return urns.select("sample_id", "urns", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("item")).select("sample_id", "item", F.floor(random_unit(seed, F.col("sample_id"), F.col("item")) * F.col("urns")).cast("int").alias("urn"))


def is_least(nodes: DataFrame, edges: DataFrame, forest: DataFrame) -> DataFrame:
    """One row: whether a forest(u, v) weighs as little as the least spanning forest of its closure in edges(u, v, weight)."""
    least = spanning_forest(nodes, closure(nodes, edges.select("u", "v"), forest).join(edges, ["u", "v"]))
    own = forest.join(edges, ["u", "v"]).agg(F.sum("weight").alias("own"))
    return own.join(least.agg(F.sum("weight").alias("least"))).select(F.col("own").eqNullSafe(F.col("least")).alias("is_least"))
