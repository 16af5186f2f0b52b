"""Markov chains on plans of a graph. Transitions are sequential, so a chain is one group; chains, seeds and parameters run beside each
other, and everything after is SQL over the trace."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .engine import State
from .sampling import _draw

TRACE = "chain_id long, step long, node_id long, district int, n_cut long, n_boundary long, accepted boolean"


@dataclass(frozen=True)
class FlipChain:
    """Flips of single boundary nodes of a two-district plan on a grid: accepted with probability base ** (old cut - new cut) if both
    districts stay connected and their sizes differ by ``slack`` times the number of nodes at most."""

    width: int
    height: int
    slack: float = 0.5

    def neighbours(self, k: int) -> list[int]:
        x, y = k % self.width, k // self.width
        return [k + d for ok, d in ((x > 0, -1), (x < self.width - 1, 1), (y > 0, -self.width), (y < self.height - 1, self.width)) if ok]

    def connected(self, plan: list[int], district: int) -> bool:
        """Whether the district of a plan, a list by node, is connected and not empty."""
        return State({k: self.neighbours(k) for k in range(len(plan))}, dict(enumerate(plan))).connected(district)

    def run(self, chain_id: int, base: float, steps: int, seed: int) -> list[tuple]:
        n = self.width * self.height
        near = {k: sorted(self.neighbours(k)) for k in range(n)}
        s = State(near, {k: int(k // self.width >= self.height / 2) for k in range(n)})
        ones, rows = sum(s.plan.values()), []
        for step in range(1, steps + 1):
            on_boundary = len(s.boundary)
            node = s.boundary[int(_draw(seed, step, 0) * on_boundary) % on_boundary]
            old, change = s.plan[node], sum(1 if s.plan[node] == s.plan[b] else -1 for b in near[node])
            count = ones + (1 - 2 * old)
            ok = abs(2 * count - n) <= self.slack * n and _draw(seed, step, 1) < base**-change and s.holds_without(node)
            if ok:
                s.flip(node, 1 - old)
                ones = count
            rows.append((chain_id, step, node, s.plan[node], s.n_cut, on_boundary, ok))
        return rows


def flip_traces(specs: DataFrame, chain: FlipChain, steps: int) -> DataFrame:
    """The trace of each chain of specs(chain_id, base, seed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame(chain.run(int(r.chain_id), float(r.base), steps, int(r.seed)), columns=[f.split()[0] for f in TRACE.split(", ")])

    return specs.select("chain_id", "base", "seed").mapInPandas(run, TRACE)


def summary(trace: DataFrame) -> DataFrame:
    """(chain_id, steps, acceptance, mean_cut, least_cut, flips of the most flipped node)."""
    flips = trace.where("accepted").groupBy("chain_id", "node_id").agg(F.count("*").alias("k")).groupBy("chain_id").agg(F.max("k").alias("most_flips"))
    out = trace.groupBy("chain_id").agg(F.count("*").alias("steps"), F.avg(F.col("accepted").cast("double")).alias("acceptance"), F.avg("n_cut").alias("mean_cut"), F.min("n_cut").alias("least_cut"))
    return out.join(flips, "chain_id", "left").withColumn("most_flips", F.coalesce("most_flips", F.lit(0)).cast("long"))


def occupancy(trace: DataFrame) -> DataFrame:
    """(chain_id, node_id, share): of the steps since its first proposal, the share that a node spent in district 1."""
    w = Window.partitionBy("chain_id", "node_id").orderBy("step")
    last = trace.groupBy("chain_id").agg(F.max("step").alias("end"))
    spans = trace.withColumn("to", F.lead("step").over(w)).join(F.broadcast(last), "chain_id").withColumn("length", F.coalesce("to", F.col("end") + 1) - F.col("step"))
    return spans.groupBy("chain_id", "node_id").agg((F.sum(F.col("length") * F.col("district")) / F.sum("length")).alias("share"))


def toggles(spark, n_bits: int, steps: int, chains: int, seed: int = 1) -> DataFrame:
    """(chain_id, step, mask): lazy single-bit toggles of the hypercube; the state after a step is the xor of all toggles so far, so that
    the walk is a window, not a loop."""
    from ..functions.portable import random_unit

    rows = spark.range(chains).select(F.col("id").alias("chain_id"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    bit = F.floor(random_unit(seed, F.col("chain_id") * 100_000 + F.col("step"), 0) * n_bits).cast("int")
    move = random_unit(seed, F.col("chain_id") * 100_000 + F.col("step"), 1) < 0.5
    rows = rows.withColumn("flip", F.when(move, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return rows.withColumn("mask", F.bit_xor("flip").over(Window.partitionBy("chain_id").orderBy("step"))).select("chain_id", F.col("step").cast("long").alias("step"), "mask")


EDGE_TRACE = "chain_id long, step long, u long, v long, n_cut long, n_contradictions long, accepted boolean"


def _edge_steps(near: dict[int, list[int]], chain_id: int, temperature: float, fugacity: float, steps: int, seed: int) -> Iterator[tuple]:
    edges = sorted((u, v) for u in near for v in near[u] if u < v)
    label, kept = {k: k for k in near}, {k: set() for k in near}
    cut, bad = set(edges), 0

    def reach(start: int) -> set[int]:
        seen, todo = {start}, [start]
        while todo:
            for x in kept[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    for step in range(1, steps + 1):
        u, v = e = edges[int(_draw(seed, step, 1) * len(edges)) % len(edges)]
        moves = _draw(seed, step, 0) >= 0.5
        if moves:
            # What the toggle does to the edge's own component alone: its nodes' labels, and contradictions at them.
            if e in cut:
                part = set() if label[u] == label[v] else reach(u)
                to, gain = label[v], 1
            else:
                kept[u].discard(v)
                kept[v].discard(u)
                part = reach(u)
                if v in part:
                    part = set()
                elif label[u] in part:  # a component's label is one of its nodes: the part without it takes a new one
                    part = reach(v)
                to, gain = min(part, default=0), -1
            crossing = [(a, b) for a in part for b in near[a] if b not in part and (min(a, b), max(a, b)) in cut]
            before = sum(label[a] == label[b] for a, b in crossing)
            after = sum(to == label[b] for a, b in crossing)
            change = after - before
            if gain > 0:  # the edge itself is a contradiction no more, or counted in after
                change -= 1
            elif not part:
                change += 1
            moves = temperature**change * fugacity**-gain > _draw(seed, step, 2)
            if moves:
                for a in part:
                    label[a] = to
                bad += change
                if gain > 0:
                    cut.discard(e)
                    kept[u].add(v)
                    kept[v].add(u)
                else:
                    cut.add(e)
            elif gain < 0:
                kept[u].add(v)
                kept[v].add(u)
        yield chain_id, step, u, v, len(cut), bad, moves


def edge_toggles(specs: DataFrame, edges: DataFrame, steps: int, max_edges: int = 1 << 16) -> DataFrame:
    """The trace of each chain of specs(chain_id, temperature, fugacity, seed) on subsets of edges(u, v): all are cut first; in half of the steps a uniform
    edge is toggled, and stays so with probability temperature ** (more contradictions) * fugacity ** (more cut edges), 1 at most. A contradiction
    is a cut edge whose ends the other edges connect. A step works on the component of the toggled edge alone."""
    half = [(int(r.u), int(r.v)) for r in edges.select("u", "v").limit(max_edges + 1).collect()]
    if len(half) > max_edges:
        raise ValueError(f"over {max_edges} edges")
    near: dict[int, list[int]] = {}
    for u, v in sorted({(min(e), max(e)) for e in half}):
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    shared = specs.sparkSession.sparkContext.broadcast(near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows = _edge_steps(shared.value, int(r.chain_id), float(r.temperature), float(r.fugacity), steps, int(r.seed))
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in EDGE_TRACE.split(", ")])

    return specs.select("chain_id", "temperature", "fugacity", "seed").mapInPandas(run, EDGE_TRACE)
