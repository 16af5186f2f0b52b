"""A chain engine over plans of any graph into districts: proposal, constraint and acceptance are functions of the state, updaters are named functions that
are recorded with each step. Transitions are sequential: a chain is one row of ``specs``, worked on by one task; chains run beside each other."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .walks import adjacency, draw_int

_P = 2147483647


@dataclass
class State:
    """A plan and what follows from it, kept up to date flip by flip."""

    near: dict[int, list[int]]
    plan: dict[int, int]
    seed: int = 1
    step: int = 0
    population: dict[int, float] = field(default_factory=dict)  # 1 of each node that isn't named
    params: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.nodes = sorted(self.plan)
        self.sizes: dict[int, float] = {}
        for k, d in self.plan.items():
            self.sizes[d] = self.sizes.get(d, 0) + self.population.get(k, 1)
        self.foreign = {k: sum(self.plan[x] != self.plan[k] for x in self.near.get(k, ())) for k in self.nodes}
        self.n_cut = sum(self.foreign.values()) // 2
        self.boundary = [k for k in self.nodes if self.foreign[k]]
        self._draws = 0

    def draw(self, n: int) -> int:
        """The step's next number of 0 to n - 1."""
        self._draws += 1
        return draw_int(self.seed, self.step, self._draws) % n

    def unit(self) -> float:
        return self.draw(_P) / _P

    def next_step(self) -> None:
        self.step += 1
        self._draws = 0

    def _note(self, k: int, change: int) -> None:
        was = self.foreign[k]
        self.foreign[k] = was + change
        if not was and change > 0:
            insort(self.boundary, k)
        elif was and not was + change:
            del self.boundary[bisect_left(self.boundary, k)]

    def flip(self, k: int, district: int) -> None:
        old = self.plan[k]
        if old == district:
            return
        weight = self.population.get(k, 1)
        self.sizes[old] -= weight
        self.sizes[district] = self.sizes.get(district, 0) + weight
        own = 0
        for x in self.near.get(k, ()):
            if self.plan[x] == old:
                own += 1
                self._note(x, 1)
            elif self.plan[x] == district:
                own -= 1
                self._note(x, -1)
        self.plan[k] = district
        self.n_cut += own
        if own:
            self._note(k, own)

    def holds_without(self, k: int) -> bool:
        """Whether k's district stays connected and isn't empty without k: its neighbours there reach each other."""
        district = self.plan[k]
        goals = {x for x in self.near.get(k, ()) if self.plan[x] == district}
        if not goals:
            return False
        start = goals.pop()
        seen, todo = {start, k}, [start]
        while todo and goals:
            for x in self.near[todo.pop()]:
                if x not in seen and self.plan[x] == district:
                    seen.add(x)
                    goals.discard(x)
                    todo.append(x)
        return not goals

    def connected(self, district: int) -> bool:
        mine = [k for k in self.nodes if self.plan[k] == district]
        if not mine:
            return False
        seen, todo = {mine[0]}, [mine[0]]
        while todo:
            for x in self.near.get(todo.pop(), ()):
                if x not in seen and self.plan[x] == district:
                    seen.add(x)
                    todo.append(x)
        return len(seen) == len(mine)


Flips = Sequence[tuple[int, int]]


# Proposals: the flips (node, district) of a step.


def go_nowhere(s: State) -> Flips:
    """No flip: the plan stays."""
    return ()


def boundary_flip(s: State) -> Flips:
    """A uniform boundary node goes to the district of a uniform neighbour in another."""
    if not s.boundary:
        return ()
    k = s.boundary[s.draw(len(s.boundary))]
    others = sorted({s.plan[x] for x in s.near[k]} - {s.plan[k]})
    return ((k, others[s.draw(len(others))]),)


def pair_flip(s: State) -> Flips:
    """A uniform pair of a boundary node and a district that it touches, so that the walk is reversible for any number of districts."""
    pairs = [(k, d) for k in s.boundary for d in sorted({s.plan[x] for x in s.near[k]} - {s.plan[k]})]
    return (pairs[s.draw(len(pairs))],) if pairs else ()


def recolour(s: State) -> Flips:
    """A uniform node takes a uniform colour of 0 to params["colours"] - 1."""
    return ((s.nodes[s.draw(len(s.nodes))], s.draw(int(s.params["colours"]))),)


def assignment_flip(s: State) -> Flips:
    """A uniform node takes another of two districts, 0 and 1."""
    k = s.nodes[s.draw(len(s.nodes))]
    return ((k, 1 - s.plan[k]),)


def spanning_tree(s: State, nodes: list[int], uniform: bool) -> dict[int, int | None]:
    """A tree of the connected subgraph of nodes, as parents: uniform, by loop-erased walks, or least by drawn edge weights."""
    inside = set(nodes)
    near = {k: [x for x in s.near[k] if x in inside] for k in nodes}
    parent: dict[int, int | None] = {nodes[0]: None}
    if uniform:
        for start in nodes:
            step, at = {}, start
            while at not in parent:
                step[at] = near[at][s.draw(len(near[at]))]
                at = step[at]
            at = start
            while at not in parent:
                parent[at] = step[at]
                at = step[at]
        return parent
    edges = sorted((s.draw(_P), a, b) for a in nodes for b in near[a] if a < b)
    root = {k: k for k in nodes}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    tree: dict[int, list[int]] = {k: [] for k in nodes}
    for _, a, b in edges:
        if (x := find(a)) != (y := find(b)):
            root[x] = y
            tree[a].append(b)
            tree[b].append(a)
    todo = [nodes[0]]
    while todo:
        k = todo.pop()
        for x in tree[k]:
            if x not in parent:
                parent[x] = k
                todo.append(x)
    return parent


def split_by_tree(s: State, nodes: list[int], low: float, high: float, uniform: bool = True, tries: int = 1000) -> set[int] | None:
    """One side of a cut of a drawn tree of nodes whose population, and the other side's, is between low and high; None if no tree had one."""
    total = sum(s.population.get(k, 1) for k in nodes)
    for _ in range(tries):
        parent = spanning_tree(s, nodes, uniform)
        children: dict[int, list[int]] = {k: [] for k in nodes}
        for k, p in parent.items():
            if p is not None:
                children[p].append(k)
        order, todo = [], [nodes[0]]
        while todo:
            order.append(k := todo.pop())
            todo += children[k]
        weight = {}
        for k in reversed(order):
            weight[k] = s.population.get(k, 1) + sum(weight[c] for c in children[k])
        fit = sorted(k for k in nodes if parent[k] is not None and low <= weight[k] <= high and low <= total - weight[k] <= high)
        if fit:
            side, todo = set(), [fit[s.draw(len(fit))]]
            while todo:
                side.add(k := todo.pop())
                todo += children[k]
            return side
    return None


def _tree_move(s: State, uniform: bool) -> Flips:
    pairs = sorted({(min(s.plan[k], s.plan[x]), max(s.plan[k], s.plan[x])) for k in s.boundary for x in s.near[k] if s.plan[k] != s.plan[x]})
    if not pairs:
        return ()
    a, b = pairs[s.draw(len(pairs))]
    nodes = [k for k in s.nodes if s.plan[k] in (a, b)]
    ideal, slack = (s.sizes[a] + s.sizes[b]) / 2, s.params.get("slack", 0.1)
    side = split_by_tree(s, nodes, ideal * (1 - slack), ideal * (1 + slack), uniform)
    return () if side is None else [(k, a if k in side else b) for k in nodes]


def uniform_tree_move(s: State) -> Flips:
    """Two neighbouring districts are joined and split again by a balanced cut of a uniform spanning tree."""
    return _tree_move(s, True)


def least_tree_move(s: State) -> Flips:
    """The same with the least tree by drawn weights."""
    return _tree_move(s, False)


# Constraints, of the state after the flips; ``before`` holds what the flipped nodes were.


def anything(s: State, before: Flips) -> bool:
    return True


def contiguous(s: State, before: Flips) -> bool:
    """Districts that lost nodes or won some are connected, and none that lost any is empty."""
    if len(before) == 1:
        k, old = before[0]
        new = s.plan[k]
        if new == old:
            return True
        joined = any(s.plan[x] == new for x in s.near.get(k, ()))
        s.plan[k] = old
        stays = s.holds_without(k)
        s.plan[k] = new
        return joined and stays
    return all(s.connected(d) for d in {old for _, old in before} | {s.plan[k] for k, _ in before})


def balanced(s: State, before: Flips) -> bool:
    """Each district's population is within params["slack"] of the mean."""
    mean = sum(s.sizes.values()) / len(s.sizes)
    return all(abs(x - mean) <= s.params.get("slack", 0.1) * mean for x in s.sizes.values())


def both(*constraints: Callable[[State, Flips], bool]) -> Callable[[State, Flips], bool]:
    return lambda s, before: all(c(s, before) for c in constraints)


# Acceptance: the probability, from the number of cut edges before and after.


def always(s: State, old: int, new: int) -> float:
    return 1.0


def cut_base(s: State, old: int, new: int) -> float:
    """params["base"] ** (old - new)."""
    return s.params["base"] ** (old - new)


def annealed(s: State, old: int, new: int) -> float:
    """The same with a base that grows evenly from 1 to params["base"] over params["anneal"] steps."""
    return (1 + (s.params["base"] - 1) * min(1.0, s.step / s.params["anneal"])) ** (old - new)


def fugacity(s: State, old: int, new: int) -> float:
    """params["fugacity"] ** ((new - old) / params["temperature"])."""
    return s.params["fugacity"] ** ((new - old) / s.params.get("temperature", 1.0))


UPDATERS: dict[str, Callable[[State], float]] = {
    "n_cut": lambda s: s.n_cut, "n_boundary": lambda s: len(s.boundary), "step_num": lambda s: s.step, "districts": lambda s: sum(x > 0 for x in s.sizes.values()),
    "base": lambda s: s.params.get("base", 1.0), "least_size": lambda s: min(s.sizes.values()), "largest_size": lambda s: max(s.sizes.values()),
}


def advance(s: State, propose: Callable, constraint: Callable, accept: Callable) -> tuple[bool, Flips]:
    """One step in place: whether it was accepted, and the flips."""
    s.next_step()
    flips = propose(s)
    before, cut = [(k, s.plan[k]) for k, _ in flips], s.n_cut
    for k, d in flips:
        s.flip(k, d)
    if constraint(s, before) and s.unit() < accept(s, cut, s.n_cut):
        return True, [(k, d) for (k, d), (_, old) in zip(flips, before, strict=True) if d != old]
    for k, old in before:
        s.flip(k, old)
    return False, []


TRACE = "chain_id long, step long, accepted boolean, flips array<struct<node_id:long,district:int>>, values map<string,double>"


def run_chains(
    specs: DataFrame, edges: DataFrame, start: DataFrame, steps: int, propose: Callable, constraint: Callable = contiguous, accept: Callable = always, updaters: Sequence[str] = ("n_cut",), every: int = 1
) -> DataFrame:
    """The trace of each chain of specs(chain_id, seed, params map<string,double>) from the plan start(node_id, district[, population]) of the graph edges(u, v), which
    are bounded, and broadcast: each ``every``-th step with its flips since the one before and the updaters' values."""
    near, plan, weight = _graph(edges, start)
    shared = specs.sparkSession.sparkContext.broadcast((near, plan, weight))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, plan, weight = shared.value
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                s, rows, moved = State(near, dict(plan), int(r.seed), 0, weight, dict(r.params or {})), [], {}
                for _ in range(steps):
                    ok, flips = advance(s, propose, constraint, accept)
                    moved.update(flips)
                    if s.step % every == 0:
                        rows.append((r.chain_id, s.step, ok, [{"node_id": k, "district": d} for k, d in moved.items()], {u: float(UPDATERS[u](s)) for u in updaters}))
                        moved = {}
                        if len(rows) == 4096:
                            yield pd.DataFrame(rows, columns=["chain_id", "step", "accepted", "flips", "values"])
                            rows = []
                yield pd.DataFrame(rows, columns=["chain_id", "step", "accepted", "flips", "values"])

    return specs.select(F.col("chain_id").cast("long"), F.col("seed").cast("long"), "params").mapInPandas(run, TRACE)


def _graph(edges: DataFrame, start: DataFrame, max_nodes: int = 1 << 16) -> tuple[dict, dict, dict]:
    near = adjacency(edges, 4 * max_nodes)
    rows = start.limit(max_nodes + 1).collect()
    if len(rows) > max_nodes:
        raise ValueError(f"over {max_nodes} nodes")
    weight = {int(r.node_id): float(r.population) for r in rows} if "population" in start.columns else {}
    return near, {int(r.node_id): int(r.district) for r in rows}, weight


def tempered_chains(specs: DataFrame, edges: DataFrame, start: DataFrame, bases: Sequence[float], rounds: int, steps: int, propose: Callable = boundary_flip, constraint: Callable = contiguous) -> DataFrame:
    """(chain_id, round, replica, base, n_cut, swapped): replicas of each chain of specs(chain_id, seed), one for each base, run ``steps`` steps a round; then neighbours,
    in turn, swap their plans with the probability that keeps the joint law."""
    shared = specs.sparkSession.sparkContext.broadcast(_graph(edges, start))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, plan, weight = shared.value
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                states = [State(near, dict(plan), int(r.seed) + 7919 * k, 0, weight, {"base": b}) for k, b in enumerate(bases)]
                rows = []
                for n in range(1, rounds + 1):
                    for s in states:
                        for _ in range(steps):
                            advance(s, propose, constraint, cut_base)
                    swapped = [False] * len(bases)
                    for k in range(n % 2, len(bases) - 1, 2):
                        a, b = states[k], states[k + 1]
                        if a.unit() < (bases[k] / bases[k + 1]) ** (a.n_cut - b.n_cut):
                            states[k], states[k + 1] = b, a
                            a.params, b.params = b.params, a.params
                            swapped[k] = swapped[k + 1] = True
                    rows += [(r.chain_id, n, k, float(bases[k]), s.n_cut, swapped[k]) for k, s in enumerate(states)]
                yield pd.DataFrame(rows, columns=["chain_id", "round", "replica", "base", "n_cut", "swapped"])

    return specs.select(F.col("chain_id").cast("long"), F.col("seed").cast("long")).mapInPandas(run, "chain_id long, round int, replica int, base double, n_cut long, swapped boolean")


def tree_partitions(specs: DataFrame, edges: DataFrame, start: DataFrame, districts: int, slack: float = 0.1, uniform: bool = True) -> DataFrame:
    """(sample_id, node_id, district): for each row of specs(sample_id, seed) the connected graph of start(node_id[, population]) cut into ``districts`` parts of populations within
    ``slack`` of the mean, one balanced part after the other cut off by a drawn tree; all districts are null for a sample that found none."""
    plan = start.withColumn("district", F.lit(0))
    shared = specs.sparkSession.sparkContext.broadcast(_graph(edges, plan))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, plan, weight = shared.value
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                s = State(near, dict(plan), int(r.seed), 0, weight)
                got = _parts(s, districts, slack, uniform)
                yield pd.DataFrame({"sample_id": r.sample_id, "node_id": s.nodes, "district": pd.array([None if got is None else got[k] for k in s.nodes], dtype="Int32")})

    return specs.select(F.col("sample_id").cast("long"), F.col("seed").cast("long")).mapInPandas(run, "sample_id long, node_id long, district int")


def _parts(s: State, districts: int, slack: float, uniform: bool, tries: int = 200) -> dict[int, int] | None:
    mean = sum(s.sizes.values()) / districts
    for _ in range(tries):
        left, out = list(s.nodes), {}
        for d in range(districts - 1):
            side = _one_part(s, left, mean, slack, districts - d, uniform)
            if side is None:
                break
            out |= dict.fromkeys(side, d)
            left = [k for k in left if k not in side]
        else:
            return out | dict.fromkeys(left, districts - 1)
    return None


def _one_part(s: State, nodes: list[int], mean: float, slack: float, parts: int, uniform: bool) -> set[int] | None:
    total, low, high = sum(s.population.get(k, 1) for k in nodes), mean * (1 - slack), mean * (1 + slack)
    for _ in range(20):
        parent = spanning_tree(s, nodes, uniform)
        children: dict[int, list[int]] = {k: [] for k in nodes}
        for k, p in parent.items():
            if p is not None:
                children[p].append(k)
        order, todo = [], [nodes[0]]
        while todo:
            order.append(k := todo.pop())
            todo += children[k]
        weight = {}
        for k in reversed(order):
            weight[k] = s.population.get(k, 1) + sum(weight[c] for c in children[k])
        rest = lambda w: (parts - 1) * low <= total - w <= (parts - 1) * high
        fit = [(k, True) for k in sorted(nodes) if parent[k] is not None and low <= weight[k] <= high and rest(weight[k])]
        fit += [(k, False) for k in sorted(nodes) if parent[k] is not None and low <= total - weight[k] <= high and rest(total - weight[k])]
        if fit:
            k, below = fit[s.draw(len(fit))]
            side, todo = set(), [k]
            while todo:
                side.add(x := todo.pop())
                todo += children[x]
            return side if below else set(nodes) - side
    return None
