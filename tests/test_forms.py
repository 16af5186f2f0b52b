import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import chains, connect, estimate, generators, learn, plans, polytopes, sampling, sets
from weft.operators.sampling import _draw
from weft.plans.graph_queries import numbered
from weft.plans.registry import ensure_checkpoints
from weft.streaming import monitor


@pytest.fixture(autouse=True)
def checkpoints(spark):
    ensure_checkpoints(spark)


def test_edge_toggles_by_recount(spark):
    edges = sorted((int(r.u), int(r.v)) for r in generators.lattice(spark, 3, 3).edges.collect())
    specs = spark.createDataFrame([(0, 0.3, 1.0, 5), (1, 0.8, 1.4, 6), (2, 0.5, 0.6, 7)], "chain_id long, temperature double, fugacity double, seed long")
    got = {k: [] for k in range(3)}
    for r in sorted(map(tuple, chains.edge_toggles(specs, generators.lattice(spark, 3, 3).edges, 1500).collect())):
        got[r[0]].append(r)

    def contradictions(cut):
        label = list(range(9))
        for u, v in set(edges) - cut:
            label = [label[v] if x == label[u] else x for x in label]
        return sum(label[u] == label[v] for u, v in cut)

    for chain, temperature, fugacity, seed in map(tuple, specs.collect()):
        cut, want = set(edges), []
        for step in range(1, 1501):
            e = edges[int(_draw(seed, step, 1) * len(edges)) % len(edges)]
            new = cut ^ {e}
            ok = _draw(seed, step, 0) >= 0.5 and temperature ** (contradictions(new) - contradictions(cut)) * fugacity ** (len(new) - len(cut)) > _draw(seed, step, 2)
            cut = new if ok else cut
            want.append((chain, step, *e, len(cut), contradictions(cut), ok))
        assert got[chain] == want
    with pytest.raises(ValueError):
        chains.edge_toggles(specs, generators.lattice(spark, 3, 3).edges, 1, max_edges=5)


def test_products_with_another_factor_average_to_the_matchings(spark):
    edges = generators.lattice(spark, 2, 2).edges
    a = np.zeros((4, 4))
    for r in edges.collect():
        a[r.u, r.v] = a[r.v, r.u] = 1
    c = np.linalg.cholesky(a + 4 * np.eye(4))
    factor = spark.createDataFrame([(i, k, float(c[i, k])) for i in range(4) for k in range(i + 1)], "i long, k long, c double")
    mean = estimate.spread(estimate.gaussian_products(spark, factor, 60_000, 4, 3, signed=False)).first()["mean"]
    assert abs(mean - 2) < 0.6
    mean = estimate.spread(estimate.gaussian_products(spark, estimate.incidence(numbered(generators.lattice(spark, 2, 2))), 60_000, 4, 3)).first()["mean"]
    assert abs(mean - 2) < 0.6


def test_ends_of_aligned_paths(spark):
    path = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 0.1, 0.2), (0, 2, 0.6, -0.8)], "path_id long, idx long, x double, y double")
    rows = estimate.align_paths(path, -1).orderBy("idx").collect()
    assert abs(rows[0].x + 1) < 1e-9 and abs(rows[0].y) < 1e-9 and (rows[2].x, rows[2].y) == (1.0, 0.0)


def test_least_forest(spark):
    g = generators.lattice(spark, 3, 3)
    weighted = numbered(g).select("u", "v", (F.lit(2.0) ** F.col("edge_id")).alias("weight"))
    least = sampling.spanning_forest(g.nodes, weighted).select("u", "v")
    assert sampling.is_least(g.nodes, weighted, least).first()[0]
    # A square without its lightest edge is a forest of larger weight than the square's least tree.
    square = spark.createDataFrame([(0, 3), (1, 4), (3, 4)], "u long, v long")
    assert not sampling.is_least(g.nodes, weighted, square).first()[0]
    assert connect.rank(g.nodes, square).first()["forest"]


def test_edges_of_a_solution(spark):
    x = spark.createDataFrame([(0, 0.5), (1, 5e-5), (2, 2.0), (99, 1.0)], "j long, x double")
    assert sorted(map(tuple, polytopes.edges_of(numbered(generators.lattice(spark, 2, 2)), x).collect())) == [(0, 1), (1, 3)]


def test_paths_and_weights(spark):
    assert [tuple(r) for r in plans.straight_path(spark, -2, 3, 1).orderBy("pos").collect()] == [(0, -2, 3), (1, -1, 3), (2, 0, 3), (3, 1, 3)]
    tree = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.25)], "a string, b string, weight double")
    assert learn.tree_weight(tree).first()[0] == 0.75 and learn.tree_weight(tree.limit(0)).first()[0] == 0


def test_face_flip_and_last_states(spark):
    cycle = spark.createDataFrame([(0, 1), (1, 4), (3, 4), (0, 3)], "u long, v long")
    face = spark.createDataFrame([(2, 1), (2, 5), (4, 5), (4, 1)], "u long, v long")
    assert sorted(tuple(r) for r in sets.face_flip(cycle, face).collect()) == [(0, 1), (0, 3), (1, 2), (2, 5), (3, 4), (4, 5)]
    trace = spark.createDataFrame([(0, 1, 5), (0, 3, 7), (0, 2, 6), (1, 1, 2)], "chain_id long, step long, n_cut long")
    assert sorted(map(tuple, monitor.last_states(trace).collect())) == [(0, 3, 7), (1, 1, 2)]
