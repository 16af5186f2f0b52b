import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft.functions.portable import cdiv, cmul, pair, random_int
from weft.operators import chains, combinatorics, connect, enumerate, estimate, generators, graph, learn, sampling, statistics
from weft.plans.registry import ensure_checkpoints


@pytest.fixture(autouse=True)
def checkpoints(spark):
    ensure_checkpoints(spark)


def test_known_counts_of_connected_partitions(spark):
    for size, n in [((2, 2), 12), ((3, 2), 74), ((4, 3), 27780)]:
        assert int(enumerate.connected_partitions(spark, *size).first()[0]) == n


def test_known_counts_of_simple_paths(spark):
    for n, want in [(2, 2), (3, 12), (4, 184)]:
        total = enumerate.simple_paths(generators.lattice(spark, n, n).edges, 0, n * n - 1, n * n - 1).agg(F.sum("n_paths")).first()[0]
        assert int(total) == want


def test_random_numbers_by_hand(spark):
    from weft.operators.sampling import P, _draw

    got = [r[0] for r in spark.range(50).select(random_int(7, F.col("id"), 3)).collect()]
    assert got == [round(_draw(7, k, 3) * P) for k in range(50)]


def test_complex_columns(spark):
    r = spark.range(1).select(cmul(pair(F.lit(1), F.lit(2)), pair(F.lit(3), F.lit(-1))).alias("m"), cdiv(pair(F.lit(5), F.lit(5)), pair(F.lit(1), F.lit(2))).alias("d")).first()
    assert (r.m.re, r.m.im, r.d.re, r.d.im) == (5, 5, 3, -1)


def test_components_of_long_paths_and_many_keys(spark):
    edges = spark.range(3).select(F.col("id").alias("k")).crossJoin(spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    nodes = spark.range(3).select(F.col("id").alias("k")).crossJoin(spark.range(202).select(F.col("id").alias("node_id")))
    got = Counter((r.k, r.comp) for r in connect.components(nodes, edges, ("k",)).collect())
    assert got == {(k, c): n for k in range(3) for c, n in ((0, 201), (201, 1))}


def test_graph_helpers(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3)], "u long, v long")
    assert sorted(map(tuple, graph.normalise(e).collect())) == [(1, 2), (2, 3)]
    assert sorted(map(tuple, graph.smooth_node(graph.normalise(e), 2).collect())) == [(1, 3)]
    assert graph.remove_edge(e, 2, 1).count() == 2


def test_loop_erasure_against_walking(spark):
    rng = random.Random(2)
    walks = {w: [rng.randrange(8) for _ in range(rng.choice([1, 2, 30]))] for w in range(20)}
    rows = [(w, i, n) for w, walk in walks.items() for i, n in zip(range(99), walk)]
    got = {}
    for r in statistics.loop_erasure(spark.createDataFrame(rows, "walk_id long, idx long, node_id long")).orderBy("walk_id", "pos").collect():
        got.setdefault(r.walk_id, []).append(r.node_id)
    for w, walk in walks.items():
        path = []
        for n in walk:
            path = path[: path.index(n) + 1] if n in path else [*path, n]
        assert got[w] == path


def test_spanning_trees(spark):
    g = generators.lattice(spark, 4, 3)
    trees = sampling.wilson_trees(spark, g.edges, 30, 4)
    comp = connect.components(spark.range(30).select(F.col("id").alias("sample_id")).crossJoin(g.nodes.select("node_id")), trees, ("sample_id",))
    assert comp.where("comp <> 0").count() == 0 and trees.count() == 30 * 11


def test_wilson_trees_fail_rather_than_drop_edges(spark):
    for edges, kw, says in [(spark.range(6).selectExpr("id AS u", "id + 1 AS v"), {"max_edges": 5}, "over 5 edges"), (spark.range(1 << 16 | 1).selectExpr("id AS u", "id + 1 AS v"), {}, "over 65536 edges"), (spark.sql("SELECT * FROM VALUES (0, 1), (2, 3) AS t(u, v)"), {}, "connected")]:
        with pytest.raises(ValueError, match=says):
            sampling.wilson_trees(spark, edges, 2, **kw)
    assert sampling.wilson_trees(spark, spark.range(6).selectExpr("id AS u", "id + 1 AS v"), 2, max_edges=6).count() == 12


def test_flip_chain_keeps_its_constraints(spark):
    chain = chains.FlipChain(5, 4, slack=0.3)
    rows = chain.run(0, 1.5, 200, 3)
    plan, cut = [int(k // 5 >= 2) for k in range(20)], 5
    for _, _, node, district, n_cut, _, ok in rows:
        if ok:
            plan[node] = district
        cut = sum(plan[a] != plan[b] for a in range(20) for b in chain.neighbours(a)) // 2
        assert cut == n_cut and chain.connected(plan, 0) and chain.connected(plan, 1) and abs(2 * sum(plan) - 20) <= 6
    assert any(r[-1] for r in rows)


def test_maximum_spanning_tree_and_network(spark):
    assert learn.max_spanning_tree([("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 2.0)]) == [("a", "c"), ("c", "b")]
    rows = spark.createDataFrame([(float(k % 7), float(k % 7 > 3)) for k in range(70)], "x double, y double")
    hidden, out = learn.train_network(rows, ["x"], "y", width=2, rate=2.0, epochs=150)
    wrong = learn.network_forward(rows, ["x"], hidden, out).where("(activation > 0.5) <> (y > 0.5)").count()
    assert wrong <= 10


def test_empty_series_and_ties(spark):
    none = spark.createDataFrame([], "k long, t long, v double")
    assert statistics.running_mean(none, "k", ["t"], "v").count() == 0
    assert statistics.run_lengths(spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, 5.0)], none.schema), "k", ["t"], "v").select("n").orderBy("start").collect()[0].n == 2
    filled = statistics.fill_between(spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 4.0)], none.schema), "k", "t", "v").orderBy("t").collect()
    assert [r.filled for r in filled] == [None, 2.0, 3.0, 4.0]


def test_combinatorics_and_paths(spark):
    assert [int(r.c) for r in combinatorics.central_binomials(spark, 20).orderBy("m").collect()][:6] == [1, 2, 6, 20, 70, 252]
    path = estimate.midpoint_path(spark, 5, 3).orderBy("t").collect()
    assert [r.t for r in path] == [k / 32 for k in range(33)] and path[0].pos == 0
    with pytest.raises(ValueError):
        combinatorics.binomials(spark, 61)
