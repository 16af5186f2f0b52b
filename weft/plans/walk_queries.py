"""Queries on box scores, matrices of counts, walks and chains, with SQL for each that has any."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import P
from ..operators import box_scores, chains, combinatorics, engine, frontier, generators, walks
from .graph_queries import grid_sql
from .registry import Registry

R = Registry()
_SCORES = ("plain", "re", "im", "smooth", "smooth_re", "smooth_im")


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def _box(spark: SparkSession, m: int) -> DataFrame:
    return spark.range(m * m).select(F.col("id").alias("node_id"), (F.col("id") % m).cast("int").alias("x"), F.expr(f"cast(id div {m} as int)").alias("y"))


_BOX = """b AS (SELECT i AS node_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y FROM range(64) r(i)),
e AS (SELECT *, CASE WHEN x = 0 THEN 1 ELSE 0 END AS l, CASE WHEN x = 7 THEN 1 ELSE 0 END AS r, CASE WHEN y = 0 THEN 1 ELSE 0 END AS d, CASE WHEN y = 7 THEN 1 ELSE 0 END AS u, exp(-1 * (x - 4.0) * (x - 4.0) / 8) AS gx, exp(-1 * (y - 4.0) * (y - 4.0) / 8) AS gy FROM b),
s AS (SELECT node_id, x, y, CAST(l + r - d - u AS DOUBLE) AS plain, CAST(l - r AS DOUBLE) AS re, CAST(d - u AS DOUBLE) AS im, (l + r) * gy - (d + u) * gx AS smooth, (l - r) * gx AS smooth_re, (d - u) * gy AS smooth_im FROM e WHERE l + r + d + u > 0)"""
_ROUND = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _SCORES)
_SUMS = ", ".join(f"round(coalesce(sum({c}), 0), 6) + 0.0 AS {c}" for c in _SCORES)


@R.add("box_scores", f"WITH {_BOX} SELECT node_id, x, y, {_ROUND} FROM s")
def box_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(box_scores.boundary_scores(_box(spark, 8), 8), *_SCORES)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 64).alias("node_id"))


_BLOCKS = "k AS (SELECT l_orderkey AS block_id, (l_partkey * 7 + l_linenumber) % 64 AS node_id FROM lineitem)"


@R.add("restricted_blocks", f"WITH {_BOX}, {_BLOCKS} SELECT block_id, k.node_id, count(*) AS n FROM k JOIN s USING (node_id) GROUP BY ALL")
def restricted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_scores.restrict(_blocks(spark, sf_dir), box_scores.boundary_scores(_box(spark, 8), 8)).groupBy("block_id", "node_id").agg(F.count("*").alias("n"))


@R.add("block_scores", f"WITH {_BOX}, {_BLOCKS} SELECT block_id, {_SUMS} FROM k LEFT JOIN s USING (node_id) GROUP BY block_id")
def block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(box_scores.block_score(_blocks(spark, sf_dir), box_scores.boundary_scores(_box(spark, 8), 8), *_SCORES), *_SCORES)


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), (F.col("l_partkey") % 64).alias("u"), (F.col("l_suppkey") * 5 % 64).alias("v"))


_ENDS = "k AS (SELECT l_orderkey AS block_id, l_partkey % 64 AS u, l_suppkey * 5 % 64 AS v FROM lineitem)"


@R.add("endpoint_scores", f"WITH {_BOX}, {_ENDS} SELECT block_id, {_SUMS} FROM (SELECT block_id, unnest([u, v]) AS node_id FROM k) LEFT JOIN s USING (node_id) GROUP BY block_id")
def endpoint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(box_scores.endpoint_score(_ends(spark, sf_dir), box_scores.boundary_scores(_box(spark, 8), 8), *_SCORES), *_SCORES)


@R.add("endpoint_middles", f"WITH {_BOX}, {_ENDS} SELECT block_id, u, v, (a.x + c.x) / 2 AS x, (a.y + c.y) / 2 AS y FROM k JOIN b a ON u = a.node_id JOIN b c ON v = c.node_id")
def endpoint_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_scores.midpoints(_ends(spark, sf_dir), _box(spark, 8))


_LN1 = "round(lgamma(2 * n + 1) - lgamma(n + 1) - lgamma(n - 6 + 1), 6)"


@R.add("ratio_families", f"SELECT 1 AS family, k, d, {_LN1} AS ln_v FROM (SELECT *, k * d AS n FROM range(1, 4) a(k), range(9, 15) b(d)) UNION ALL SELECT 2, k, d, round(k * d * ln(4), 6) FROM range(1, 7) a(k), range(3, 9) b(d)")
def ratio_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combinatorics.ratio_families(spark, 6).select("family", "k", "d", F.round(F.log("v"), 6).alias("ln_v"))


@R.add("shifted_binomials", "SELECT k, r, d, round(lgamma(2 * n + 1) - lgamma(n + r + 1) - lgamma(n - r + 1), 6) AS ln_v FROM (SELECT *, k * d AS n FROM range(1, 4) a(k), range(3) b(r), range(3, 100) c(d))")
def shifted_binomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combinatorics.shifted_binomials(spark, 3, 3, 100).select("k", "r", "d", F.round(F.log("v"), 6).alias("ln_v"))


@R.add("stationary_weights", "SELECT CAST(k AS INTEGER) AS k, CAST(factorial(CAST(24 - k AS INTEGER)) AS DECIMAL(38,0)) AS weight FROM range(25) a(k)")
def stationary_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combinatorics.stationary_weights(spark, 24)


def _matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").where("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    entries = F.array(F.col("q"), (F.col("p") % 7 + 1).cast("double"), (F.col("s") % 5).cast("double"))
    return rows.select(F.col("l_orderkey").alias("matrix_id"), (F.col("l_linenumber") - 1).alias("i"), F.posexplode(entries).alias("j", "v"))


_CLEARED = """g AS (SELECT l_orderkey AS matrix_id, l_linenumber AS i, min(l_quantity) AS a, CAST(min(l_partkey) % 7 + 1 AS DOUBLE) AS b, CAST(min(l_suppkey) % 5 AS DOUBLE) AS c FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
m AS (SELECT matrix_id, coalesce(max(a) FILTER (i = 1), 0) AS a00, coalesce(max(b) FILTER (i = 1), 0) AS a01, coalesce(max(c) FILTER (i = 1), 0) AS a02, coalesce(max(a) FILTER (i = 2), 0) AS a10, coalesce(max(b) FILTER (i = 2), 0) AS a11, coalesce(max(c) FILTER (i = 2), 0) AS a12,
  coalesce(max(a) FILTER (i = 3), 0) AS a20, coalesce(max(b) FILTER (i = 3), 0) AS a21, coalesce(max(c) FILTER (i = 3), 0) AS a22 FROM g GROUP BY matrix_id),
n AS (SELECT *, a11 * a00 - a01 * a10 AS det2, a00 * (a11 * a22 - a12 * a21) - a01 * (a10 * a22 - a12 * a20) + a02 * (a10 * a21 - a11 * a20) AS det3 FROM m),
z AS (SELECT matrix_id, a00, a11, a22, det2 / nullif(a00, 0) AS d1, CASE WHEN a00 <> 0 THEN det3 / nullif(det2, 0) END AS d2 FROM n)"""


@R.add("cleared_diagonals", f"WITH {_CLEARED} SELECT matrix_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS i, unnest([a00, d1, d2]) + 0.0 AS v FROM z")
def cleared_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combinatorics.clear_right(_matrices(spark, sf_dir)).where("i = j").select("matrix_id", "i", (F.col("v") + F.lit(0.0)).alias("v"))


@R.add("diagonal_bounds", f"WITH {_CLEARED} SELECT matrix_id, a00 <= 2 * a00 AND d1 <= 2 * a11 AND d2 <= 2 * a22 AS holds FROM z WHERE d2 IS NOT NULL AND a00 <> 0 AND matrix_id IN (SELECT matrix_id FROM g GROUP BY 1 HAVING count(*) = 3)")
def diagonal_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _matrices(spark, sf_dir)
    whole = a.groupBy("matrix_id").agg(F.count("*").alias("n")).where("n = 9").select("matrix_id")
    a = a.join(whole, "matrix_id", "left_semi")
    cleared = combinatorics.clear_right(a)
    solved = cleared.groupBy("matrix_id").agg(F.count("v").alias("n")).where("n = 9").select("matrix_id")
    return combinatorics.diagonal_bound(cleared.join(solved, "matrix_id", "left_semi"), a)


def _five(r: str) -> str:
    return f"((((({r})*({r})%{P})*(({r})*({r})%{P}))%{P})*({r})%{P})"


_NEXT = _five(f"({_five(f'((48271 * 3 + walk_id * 69621 + (idx + 1) * 16807 + 12345) % {P})')}*48271+11)%{P}")
_WALKS = f"""{grid_sql(6, 6)}, near AS (SELECT a, list(b ORDER BY b) AS next FROM (SELECT u AS a, v AS b FROM edges UNION ALL SELECT v, u FROM edges) GROUP BY a),
w AS (SELECT i AS walk_id, CAST(0 AS BIGINT) AS idx, CAST(i * 5 % 36 AS BIGINT) AS node_id, [CAST(i * 5 % 36 AS BIGINT)] AS seen FROM range(12) r(i)
  UNION ALL SELECT walk_id, idx + 1, next[CAST({_NEXT} % len(next) AS BIGINT) + 1], list_distinct(list_append(seen, next[CAST({_NEXT} % len(next) AS BIGINT) + 1])) FROM w JOIN near ON node_id = a WHERE len(seen) < 14)"""


def _walks(spark: SparkSession) -> DataFrame:
    starts = spark.range(12).select(F.col("id").alias("walk_id"), (F.col("id") * 5 % 36).alias("node_id"))
    return walks.covering_walks(starts, generators.lattice(spark, 6, 6).edges, 14, seed=3)


@R.add("covering_walks", f"WITH RECURSIVE {_WALKS} SELECT walk_id, idx, node_id FROM w")
def covering_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walks(spark)


@R.add("covering_trees", f"WITH RECURSIVE {_WALKS} SELECT walk_id, u, node_id AS v FROM (SELECT walk_id, node_id, lag(node_id) OVER (PARTITION BY walk_id ORDER BY idx) AS u, row_number() OVER (PARTITION BY walk_id, node_id ORDER BY idx) AS k FROM w) WHERE k = 1 AND u IS NOT NULL")
def covering_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.first_entrances(_walks(spark))


@R.add("event_entrances", "SELECT walk_id, u, v FROM (SELECT user_id AS walk_id, event_type AS v, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS u, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1 AND u IS NOT NULL")
def event_entrances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.first_entrances(t(spark, sf_dir, "events").select(F.col("user_id").alias("walk_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("node_id")))


@R.add("supplier_supernode", "SELECT node_id, degree FROM (SELECT node_id, count(*) AS degree FROM (SELECT unnest([l_partkey, 100000000 + l_suppkey]) AS node_id FROM lineitem) GROUP BY node_id) ORDER BY degree DESC, node_id LIMIT 1")
def supplier_supernode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.supernode(t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 100_000_000).alias("v")))


@R.add("cycle_edges", "WITH RECURSIVE f AS (SELECT i, (i * i + 1) % 211 AS j FROM range(211) r(i)), c(k, i) AS (SELECT 0, i FROM f UNION ALL SELECT DISTINCT k + 1, j FROM c JOIN f USING (i) WHERE k < 211), x AS (SELECT i FROM c WHERE k = 211) SELECT DISTINCT least(i, j) AS u, greatest(i, j) AS v FROM f JOIN x USING (i) WHERE i <> j AND (j * j + 1) % 211 <> i")
def cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    j = (i * i + 1) % 211
    return walks.cycle_edges(spark.range(211).select(F.least(i, j).alias("u"), F.greatest(i, j).alias("v")).where("u <> v").distinct())


@R.add("vectors_in_rectangle", "SELECT label, count(*) FILTER (list_max(embedding) <= 0.5) AS inside, count(*) AS n FROM embeddings GROUP BY label")
def vectors_in_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(F.forall("embedding", lambda x: x <= 0.5)).alias("inside"), F.count("*").alias("n"))


@R.add("near_shares", "SELECT l_returnflag, round(avg(CASE WHEN abs(l_discount - 0.04) <= 0.011 THEN 1.0 ELSE 0.0 END), 9) AS share FROM lineitem GROUP BY l_returnflag")
def near_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.when(F.abs(F.col("l_discount") - 0.04) <= 0.011, 1.0).otherwise(0.0)), 9).alias("share"))


@R.add("least_suppliers", "SELECT s_nationkey, min_by(s_suppkey, s_acctbal) AS s_suppkey FROM supplier GROUP BY s_nationkey")
def least_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min_by("s_suppkey", "s_acctbal").alias("s_suppkey"))


@R.add("next_distances", "SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda k: (CAST(a.embedding[k] AS DOUBLE) - b.embedding[k]) ** 2))), 6) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def next_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", F.round(F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), 6).alias("dist"))


def _columns(spark: SparkSession, m: int, districts: int) -> tuple[DataFrame, DataFrame]:
    """The edges of an m x m lattice and its plan of upright stripes."""
    g = generators.lattice(spark, m, m)
    return g.edges, g.nodes.select("node_id", F.floor(F.col("node_id") % m * districts / m).cast("int").alias("district"))


def _chain_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, 17 + k, {"base": b, "slack": 0.4, "anneal": 300.0, "fugacity": 0.6, "temperature": 0.8, "colours": 4.0}) for k, b in enumerate((1.0, 1.6, 2.6))], "chain_id long, seed long, params map<string,double>")


def _chain(propose, constraint, accept):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges, start = _columns(spark, 8, 4)
        trace = engine.run_chains(_chain_specs(spark), edges, start, 400, propose, constraint, accept, tuple(engine.UPDATERS), every=20)
        values = [F.col("values")[u].alias(u) for u in engine.UPDATERS]
        return trace.select("chain_id", "step", "accepted", F.size("flips").alias("moved"), *values)

    return query


_KEPT = engine.both(engine.balanced, engine.contiguous)
R.add("chain_pair_flips")(_chain(engine.pair_flip, _KEPT, engine.cut_base))
R.add("chain_boundary_annealed")(_chain(engine.boundary_flip, _KEPT, engine.annealed))
R.add("chain_recolour")(_chain(engine.recolour, engine.contiguous, engine.fugacity))
R.add("chain_stays")(_chain(engine.go_nowhere, engine.anything, engine.always))


@R.add("chain_tree_moves")
def chain_tree_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, start = _columns(spark, 8, 4)
    trace = engine.run_chains(_chain_specs(spark), edges, start, 12, engine.uniform_tree_move, engine.anything, engine.always, ("n_cut", "least_size", "largest_size"))
    return trace.select("chain_id", "step", "accepted", F.size("flips").alias("moved"), *[F.col("values")[u].alias(u) for u in ("n_cut", "least_size", "largest_size")])


@R.add("chain_tempered")
def chain_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, start = _columns(spark, 8, 2)
    return engine.tempered_chains(_chain_specs(spark).select("chain_id", "seed"), edges, start, (1.0, 1.5, 2.5, 4.0), 10, 50)


@R.add("tree_partitions")
def tree_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, start = _columns(spark, 8, 4)
    specs = spark.range(20).select(F.col("id").alias("sample_id"), (F.col("id") + 5).alias("seed"))
    return engine.tree_partitions(specs, edges, start.select("node_id"), 4)


def _grids(spark: SparkSession, sizes: list[tuple]) -> DataFrame:
    """graph_id, u, v of lattices, named by their sizes; s and t are opposite corners."""
    out = None
    for size in sizes:
        g = generators.lattice(spark, *size)
        rows = g.edges.select(F.lit("x".join(map(str, size))).alias("graph_id"), F.lit(0).alias("s"), F.lit(math.prod(size) - 1).alias("t"), "u", "v")
        out = rows if out is None else out.union(rows)
    return out


# Walks without repeats are enumerated up to 5 x 5; the larger counts are known values.
_PATHS = """WITH RECURSIVE e AS (SELECT n, i AS a, unnest(list_filter([CASE WHEN i % n < n - 1 THEN i + 1 END, CASE WHEN i % n > 0 THEN i - 1 END, CASE WHEN i + n < n * n THEN i + n END, CASE WHEN i >= n THEN i - n END], lambda x: x IS NOT NULL)) AS b
  FROM range(2, 6) q(n), range(25) r(i) WHERE i < n * n),
p AS (SELECT n, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS mask FROM range(2, 6) q(n) UNION ALL SELECT p.n, b, mask | (CAST(1 AS BIGINT) << b) FROM p JOIN e ON e.n = p.n AND a = k WHERE mask & (CAST(1 AS BIGINT) << b) = 0 AND k <> p.n * p.n - 1)
SELECT n || 'x' || n AS graph_id, CAST(count(*) AS DECIMAL(38,0)) AS n FROM p WHERE k = n * n - 1 GROUP BY p.n UNION ALL SELECT * FROM (VALUES ('6x6', 1262816), ('7x7', 575780564), ('8x8', 789360053252)) v(graph_id, n)"""


@R.add("simple_path_counts", _PATHS)
def simple_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.simple_path_counts(_grids(spark, [(n, n) for n in range(2, 9)])).drop("states")


# Known values of the count of partitions of a grid into connected blocks.
_FLATS = [("2x2", 12), ("3x3", 1434), ("5x3", 538150), ("4x4", 1691690), ("5x5", 19719299768), ("2x2x2", 958), ("3x2x2", 81224)]


@R.add("flat_counts", f"SELECT graph_id, CAST(n AS DECIMAL(38,0)) AS n FROM (VALUES {', '.join(map(str, _FLATS))}) v(graph_id, n)")
def flat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.flat_counts(_grids(spark, [tuple(map(int, k.split("x"))) for k, _ in _FLATS])).drop("states")


@R.add("flip_chain_40x40")
def flip_chain_40x40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of 10,000 steps on 40 x 40 nodes, base 6.96, sizes within a twentieth."""
    specs = spark.createDataFrame([(1, 6.96, 1)], "chain_id long, base double, seed int")
    return chains.summary(chains.flip_traces(specs, chains.FlipChain(40, 40, 0.05), 10_000))
