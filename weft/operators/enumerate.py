"""Exact counting: frontier and layered dynamic programming as joins and sums, and bitmask enumeration for small families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _first_labels(state: Column) -> Column:
    """Labels renumbered in order of first appearance, so that equal partitions of the frontier are equal arrays."""
    return F.transform(state, lambda x: F.array_position(F.array_distinct(state), x).cast("int"))


def connected_partitions(spark: SparkSession, width: int, height: int) -> DataFrame:
    """One row: how many partitions of a grid's nodes have only connected blocks.

    Frontier search, a node at a time. A state is the partition of the frontier into components of kept edges, with the pairs of
    components that cut edges keep apart; its count is a DECIMAL(38,0). A round is one projection and one grouped sum.
    """
    states = spark.sql("SELECT cast(array() AS array<int>) AS lab, cast(array() AS array<string>) AS apart, cast(1 AS decimal(38,0)) AS n")
    n = width * height
    for node in range(n):
        x = node % width
        # The new node joins the end of the frontier with a label of its own.
        states = states.withColumn("lab", F.concat("lab", F.array(F.lit(1000))))
        size = min(node, width) + 1
        edges = ([size - 2] if x else []) + ([0] if node >= width else [])
        for other in edges:
            a, b = F.least(F.col("lab")[size - 1], F.col("lab")[other]), F.greatest(F.col("lab")[size - 1], F.col("lab")[other])
            states = states.withColumn("a", a).withColumn("b", b).withColumn("pair", F.concat_ws("-", "a", "b"))
            keep = states.where(~F.array_contains("apart", F.col("pair"))).select(
                F.transform("lab", lambda y: F.when(y == F.col("b"), F.col("a")).otherwise(y)).alias("lab"),
                F.array_distinct(F.transform("apart", lambda p: _renamed(p, F.col("b"), F.col("a")))).alias("apart"), "n",
            )
            cut = states.where("a <> b").select("lab", F.array_union("apart", F.array("pair")).alias("apart"), "n")
            states = keep.union(cut)
        if node >= width:  # the oldest node of the frontier has met all its neighbours
            states = states.withColumn("lab", F.slice("lab", 2, size - 1))
        states = states.withColumn("apart", F.filter("apart", lambda p: F.forall(F.split(p, "-"), lambda y: F.array_contains("lab", y.cast("int")))))
        old = F.array_distinct("lab")
        renumber = lambda y: F.array_position(F.array_distinct("lab"), y.cast("int")).cast("int")
        states = states.select(
            _first_labels(F.col("lab")).alias("lab2"), old.alias("old"), "apart", "n", "lab",
        ).select(
            F.col("lab2"), F.array_sort(F.array_distinct(F.transform("apart", lambda p: F.array_join(F.transform(F.array_sort(F.transform(F.split(p, "-"), renumber)), lambda z: z.cast("string")), "-")))).alias("apart"), "n",
        ).select(F.col("lab2").alias("lab"), "apart", "n")
        states = states.groupBy("lab", "apart").agg(F.sum("n").cast("decimal(38,0)").alias("n")).checkpoint()
    return states.agg(F.sum("n").cast("decimal(38,0)").alias("n_partitions"))


def _renamed(p: Column, old: Column, new: Column) -> Column:
    ends = F.transform(F.split(p, "-"), lambda y: F.when(y.cast("int") == old, new).otherwise(y.cast("int")))
    return F.array_join(F.transform(F.array_sort(ends), lambda z: z.cast("string")), "-")


def edge_subsets(edges: DataFrame, n_edges: int) -> DataFrame:
    """(mask, u, v, kept): every subset of up to 24 numbered edges(edge_id, u, v), a row for each edge."""
    if n_edges > 24:
        raise ValueError("more than 24 edges make too many subsets to list")
    masks = edges.sparkSession.range(1 << n_edges).select(F.col("id").alias("mask"))
    return masks.crossJoin(F.broadcast(edges)).select("mask", "edge_id", "u", "v", F.expr("(mask >> cast(edge_id AS int)) & 1 = 1").alias("kept"))


def flats(nodes: DataFrame, edges: DataFrame, n_edges: int) -> DataFrame:
    """(mask, n_blocks): the edge subsets that are exactly the edges within their components; one for each connected partition."""
    from .connect import components

    rows = edge_subsets(edges, n_edges).checkpoint()
    masks = rows.select("mask").distinct()
    labels = components(masks.crossJoin(F.broadcast(nodes.select("node_id"))), rows.where("kept").select("mask", "u", "v"), ("mask",))
    a, b = labels.select("mask", F.col("node_id").alias("u"), F.col("comp").alias("cu")), labels.select("mask", F.col("node_id").alias("v"), F.col("comp").alias("cv"))
    bad = rows.where("NOT kept").join(a, ["mask", "u"]).join(b, ["mask", "v"]).where("cu = cv").select("mask").distinct()
    return labels.join(bad, "mask", "left_anti").groupBy("mask").agg(F.countDistinct("comp").alias("n_blocks"))


def simple_paths(edges: DataFrame, source: int, target: int, longest: int) -> DataFrame:
    """(length, n_paths): simple paths from source to target by number of edges. Rounds of one join; of paths at the same node
    over the same set of nodes only the number is kept."""
    half = F.broadcast(edges.select(F.col("u").alias("at"), F.col("v").alias("to")).union(edges.select("v", "u")).distinct())
    state = edges.sparkSession.sql(f"SELECT {source}L AS at, array({source}L) AS seen, cast(1 AS decimal(38,0)) AS n, 0 AS length")
    done = None
    for length in range(1, longest + 1):
        state = state.where(F.col("at") != target).join(half, "at").where(~F.array_contains("seen", F.col("to")))
        state = state.select(F.col("to").alias("at"), F.array_sort(F.concat("seen", F.array("to"))).alias("seen"), "n").groupBy("at", "seen").agg(F.sum("n").cast("decimal(38,0)").alias("n")).checkpoint()
        ended = state.where(F.col("at") == target).agg(F.sum("n").cast("decimal(38,0)").alias("n_paths")).where("n_paths IS NOT NULL").select(F.lit(length).alias("length"), "n_paths")
        done = ended if done is None else done.union(ended)
        if not state.limit(1).count():
            break
    return done


def layered_weights(edges: DataFrame, weights: DataFrame, layers: int) -> DataFrame:
    """(i, weight, n_paths): paths from place 0 of layer 0 to each place of the last layer, by the sum of weights(layer, i, weight) on them."""
    spark = edges.sparkSession
    state = spark.sql("SELECT 0 AS i, 0L AS weight, cast(1 AS decimal(38,0)) AS n")
    for layer in range(layers):
        step = edges.where(F.col("layer") == layer).select("i", "j").join(weights.where(F.col("layer") == layer + 1).select(F.col("i").alias("j"), F.col("weight").alias("w")), "j")
        state = state.join(step, "i").groupBy(F.col("j").alias("i"), (F.col("weight") + F.col("w")).alias("weight")).agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    return state.select("i", "weight", F.col("n").alias("n_paths"))


def unique_least(distribution: DataFrame) -> DataFrame:
    """(i, least, n_least, flag) of layered_weights(): the least weight, how many paths have it, and 0, 1, 2 for none, one, several."""
    w = Window.partitionBy("i").orderBy("weight")
    first = distribution.withColumn("r", F.row_number().over(w)).where("r = 1")
    return first.select("i", F.col("weight").alias("least"), F.col("n_paths").alias("n_least"), F.when(F.col("n_paths") > 1, 2).otherwise(1).cast("int").alias("flag"))


def mod2(terms: DataFrame, *keys: str) -> DataFrame:
    """The rows that occur an odd number of times, once each."""
    return terms.groupBy(*keys).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*keys)


def partial_evaluations(poly: DataFrame, n: int) -> DataFrame:
    """(poly_id, depth, n_distinct): how many different polynomials over two elements arise from poly(poly_id, term_mask) when the first
    ``depth`` of n variables are set in all ways."""
    spark = poly.sparkSession
    settings = spark.range(n + 1).select(F.col("id").cast("int").alias("depth")).select("depth", F.explode(F.expr("sequence(0L, (1L << depth) - 1)")).alias("ones"))
    low = F.expr("(1L << depth) - 1")
    rows = poly.crossJoin(F.broadcast(settings)).where((F.col("term_mask").bitwiseAND(low)).bitwiseAND(F.bitwise_not("ones")) == 0)
    left = mod2(rows.select("poly_id", "depth", "ones", F.col("term_mask").bitwiseAND(F.bitwise_not(low)).alias("rest")), "poly_id", "depth", "ones", "rest")
    left = left.groupBy("poly_id", "depth", "ones").agg(F.array_sort(F.collect_list("rest")).alias("terms"))
    every = poly.select("poly_id").distinct().crossJoin(settings)
    return every.join(left, ["poly_id", "depth", "ones"], "left").groupBy("poly_id", "depth").agg(F.countDistinct(F.coalesce("terms", F.expr("cast(array() as array<bigint>)"))).alias("n_distinct"))


def subsets(spark: SparkSession, n: int) -> DataFrame:
    """(mask, size) of all subsets of n things."""
    return spark.range(1 << n).select(F.col("id").alias("mask"), F.bit_count("id").cast("int").alias("size"))


def metagraph(masks: DataFrame) -> DataFrame:
    """(a, b): pairs of masks(mask) that differ in one bit. Each mask looks for its neighbours; not all pairs are formed."""
    flips = masks.select(F.col("mask").alias("a"), F.explode(F.expr("transform(sequence(0, 61), k -> mask ^ (1L << k))")).alias("b")).where("a <> b")
    return flips.join(masks.select(F.col("mask").alias("b")), "b", "left_semi").select("a", "b")


def primes(spark: SparkSession, limit: int) -> DataFrame:
    numbers = spark.range(2, limit)
    small = spark.range(2, int(limit**0.5) + 1)
    composite = small.select(F.explode(F.expr(f"sequence(id * id, {limit - 1}, id)")).alias("id")).distinct()
    return numbers.join(composite, "id", "left_anti").select(F.col("id").alias("p"))


def fibonacci(spark: SparkSession, limit: int) -> DataFrame:
    """Fibonacci numbers below a limit, from 0, 1, 1, by Binet's formula rounded, exact below 2**53."""
    terms = spark.range(0, 79).select(F.col("id").alias("k"), F.expr("cast(round(pow((1 + sqrt(5)) / 2, id) / sqrt(5)) AS bigint)").alias("f"))
    return terms.where(F.col("f") < limit)


def equal_sums(spark: SparkSession, p: int, k: int) -> DataFrame:
    """(a, b): pairs of multisets of two residues below k, as a*k+b codes, whose multiples by every m below p have equal sums modulo p."""
    multi = spark.range(k * k).select(F.col("id").alias("code"), F.expr(f"id div {k}").alias("x"), F.expr(f"id % {k}").alias("y")).where("x <= y")
    sums = multi.crossJoin(spark.range(1, p).select(F.col("id").alias("m"))).withColumn("s", F.expr(f"x * m % {p} + y * m % {p}"))
    profile = sums.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "s"))), lambda z: z["s"].cast("string")), ",").alias("profile"))
    a, b = profile.select(F.col("code").alias("a"), "profile"), profile.select(F.col("code").alias("b"), "profile")
    return a.join(b, "profile").where("a < b").select("a", "b")
