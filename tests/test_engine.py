from collections import Counter

import pytest

from weft.operators import engine as E
from weft.operators import generators, walks
from weft.operators.chains import FlipChain


def grid(m):
    near = {k: sorted(x for x in ([k - 1] if k % m else []) + ([k + 1] if k % m < m - 1 else []) + [k - m, k + m] if 0 <= x < m * m) for k in range(m * m)}
    return near, {k: k % m * 3 // m for k in range(m * m)}


@pytest.mark.parametrize("propose", [E.boundary_flip, E.pair_flip, E.uniform_tree_move, E.least_tree_move, E.recolour])
def test_state_follows_from_plan(propose):
    near, plan = grid(6)
    s = E.State(near, dict(plan), 5, params={"slack": 0.5, "base": 1.4, "colours": 3.0})
    moved = 0
    for _ in range(60):
        before = dict(s.plan)
        ok, flips = E.advance(s, propose, E.both(E.balanced, E.contiguous), E.cut_base)
        assert ok or s.plan == before
        assert all(s.plan[k] == d for k, d in flips)
        moved += bool(flips)
        fresh = E.State(near, dict(s.plan))
        assert (s.n_cut, s.boundary, s.foreign) == (fresh.n_cut, fresh.boundary, fresh.foreign)
        assert {d: x for d, x in s.sizes.items() if x} == fresh.sizes and all(s.connected(d) for d in range(3))
        assert all(6 <= x <= 18 for x in s.sizes.values())
    assert moved


def test_local_connectivity_is_connectivity():
    near, plan = grid(4)
    s = E.State(near, dict(plan), 3)
    for _ in range(300):
        s.next_step()
        [(k, d)] = E.recolour(E.State(near, dict(s.plan), 3, s.step, params={"colours": 3.0}))
        old = s.plan[k]
        if s.connected(old) and old != d:
            local = s.holds_without(k)
            s.flip(k, d)
            assert local == s.connected(old)


def test_uniform_trees():
    near = {0: [1, 2, 3], 1: [0, 2], 2: [0, 1, 3], 3: [0, 2]}
    s, seen = E.State(near, dict.fromkeys(range(4), 0), 9), Counter()
    for _ in range(4000):
        s.next_step()
        tree = E.spanning_tree(s, [0, 1, 2, 3], True)
        seen[frozenset(frozenset((k, p)) for k, p in tree.items() if p is not None)] += 1
    assert len(seen) == 8 and all(abs(n - 500) < 110 for n in seen.values())


def test_stationary_law_of_pair_flips():
    """A path of 5 nodes in two connected districts: plans are cut places; with pairs drawn evenly all are as likely."""
    near = {k: [x for x in (k - 1, k + 1) if 0 <= x < 5] for k in range(5)}
    s, seen = E.State(near, {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}, 4), Counter()
    for _ in range(6000):
        E.advance(s, E.pair_flip, E.contiguous, E.always)
        seen[tuple(s.plan.values())] += 1
    assert len(seen) == 4 and all(abs(n - 1500) < 250 for n in seen.values())


def test_chains_trees_and_tempering(spark):
    g = generators.lattice(spark, 6, 6)
    start = g.nodes.selectExpr("node_id", "cast(node_id % 6 div 2 as int) AS district")
    specs = spark.createDataFrame([(1, 3, {"slack": 0.5}), (2, 4, {"slack": 0.5})], "chain_id long, seed long, params map<string,double>")
    trace = E.run_chains(specs, g.edges, start, 50, E.boundary_flip, E.both(E.balanced, E.contiguous), updaters=("n_cut", "step_num"), every=10).collect()
    assert sorted((r.chain_id, r.step) for r in trace) == [(c, k) for c in (1, 2) for k in range(10, 51, 10)]
    near, plan = grid(6)
    for chain, seed in ((1, 3), (2, 4)):  # flips, replayed, lead to the plan that the updaters tell of
        state = {k: k % 6 // 2 for k in range(36)}
        for r in sorted((r for r in trace if r.chain_id == chain), key=lambda r: r.step):
            state.update({f.node_id: f.district for f in r.flips})
            assert E.State(near, dict(state)).n_cut == r["values"]["n_cut"]
    parts = E.tree_partitions(spark.range(6).selectExpr("id AS sample_id", "id AS seed"), g.edges, g.nodes.select("node_id"), 4, 0.12).collect()
    for k in range(6):
        plan = {r.node_id: r.district for r in parts if r.sample_id == k}
        s = E.State(near, plan)
        assert sorted(s.sizes) == [0, 1, 2, 3] and all(8 <= x <= 10 and s.connected(d) for d, x in s.sizes.items())
    tempered = E.tempered_chains(specs.select("chain_id", "seed"), g.edges, start.selectExpr("node_id", "cast(district > 0 as int) AS district"), (1.0, 2.0, 4.0), 8, 20).collect()
    assert len(tempered) == 2 * 8 * 3 and any(r.swapped for r in tempered)
    with pytest.raises(Exception, match="fewer than"):
        walks.covering_walks(spark.range(1).selectExpr("id AS walk_id", "id AS node_id"), g.edges, 37).count()


def test_flip_chain_against_plain_steps():
    from weft.operators.sampling import _draw

    chain = FlipChain(5, 5, 0.6)
    near, plan = grid(5)[0], {k: int(k // 5 >= 2.5) for k in range(25)}
    for _, step, node, district, n_cut, n_boundary, ok in chain.run(1, 1.5, 200, 2):
        boundary = [k for k in range(25) if any(plan[x] != plan[k] for x in near[k])]
        assert n_boundary == len(boundary) and node == boundary[int(_draw(2, step, 0) * len(boundary)) % len(boundary)]
        cuts = lambda p: sum(p[a] != p[b] for a in near for b in near[a]) // 2
        new = plan | {node: 1 - plan[node]}
        fine = all(E.State(near, dict(new)).connected(d) for d in (0, 1)) and abs(2 * sum(new.values()) - 25) <= 0.6 * 25
        assert ok == (fine and _draw(2, step, 1) < 1.5 ** (cuts(plan) - cuts(new)))
        plan = new if ok else plan
        assert (district, n_cut) == (plan[node], cuts(plan))
