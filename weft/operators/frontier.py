"""Exact counts by frontier search: edges are decided one after the other, and what has been decided is told by a state of the nodes that still have
edges to come, so that equal states are counted together. A graph is one row; graphs are spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

State = tuple


def _last(edges: list[tuple[int, int]]) -> dict[int, int]:
    """The number of each node's last edge."""
    return {k: n for n, e in enumerate(edges) for k in e}


def count_paths(edges: list[tuple[int, int]], s: int, t: int) -> tuple[int, int]:
    """Simple paths from s to t, and the largest number of states at once. A state maps each node of the frontier to the other end of its
    piece of path: itself if it has no edge yet, None inside a piece; s and t begin as the ends of one piece, and a path closes it."""
    if s == t:
        return 1, 1
    last = _last(edges)
    if s not in last or t not in last:
        return 0, 1
    states: dict[State, int] = {(t, s): 1}
    frontier, found, most = (s, t), 0, 1
    for n, (a, b) in enumerate(edges):
        grown = frontier + tuple(k for k in (a, b) if k not in frontier)
        keep = [i for i, k in enumerate(grown) if last[k] > n]
        gone = [i for i, k in enumerate(grown) if last[k] <= n]
        at = {k: i for i, k in enumerate(grown)}
        out: dict[State, int] = {}

        def put(mates: list, count: int) -> None:
            # A node without edges to come has none, or is inside a piece.
            if all(mates[i] is None or mates[i] == grown[i] for i in gone):
                key = tuple(mates[i] for i in keep)
                out[key] = out.get(key, 0) + count

        for state, count in states.items():
            mates = [*state, *grown[len(frontier) :]]
            put(mates, count)
            x, y = mates[at[a]], mates[at[b]]
            if x is None or y is None:
                continue
            if x == b:  # closes the piece that holds it; it's a path from s to t if there's no other
                if all(m is None or m == k or k in (a, b) for k, m in zip(grown, mates, strict=True)):
                    found += count
                continue
            mates = list(mates)
            mates[at[a]] = mates[at[b]] = None
            mates[at[x]], mates[at[y]] = y, x
            put(mates, count)
        states, frontier = out, tuple(grown[i] for i in keep)
        most = max(most, len(states))
    return found, most


def count_flats(edges: list[tuple[int, int]]) -> tuple[int, int]:
    """Partitions of the nodes that have edges into connected blocks, and the largest number of states at once. A state tells the frontier's blocks so far, numbered
    in order, and which of them have been told apart: an edge between two of these is cut, one within a block isn't, and any other may be either."""
    last = _last(edges)
    states: dict[State, int] = {((), frozenset()): 1}
    frontier: tuple[int, ...] = ()
    most = 1
    for n, (a, b) in enumerate(edges):
        grown = frontier + tuple(k for k in (a, b) if k not in frontier)
        keep = [i for i, k in enumerate(grown) if last[k] > n]
        ia, ib = grown.index(a), grown.index(b)
        out: dict[State, int] = {}

        def put(block: list[int], apart: set, count: int) -> None:
            name: dict[int, int] = {}
            for i in keep:
                name.setdefault(block[i], len(name))
            key = (tuple(name[block[i]] for i in keep), frozenset((min(name[x], name[y]), max(name[x], name[y])) for x, y in apart if x in name and y in name))
            out[key] = out.get(key, 0) + count

        for (known, apart), count in states.items():
            top = max(known, default=-1) + 1
            block = [*known, *range(top, top + len(grown) - len(frontier))]
            x, y = sorted((block[ia], block[ib]))
            if x == y:
                put(block, apart, count)
                continue
            put(block, {*apart, (x, y)}, count)
            if (x, y) not in apart:
                put([x if k == y else k for k in block], {(x if p == y else p, x if q == y else q) for p, q in apart}, count)
        states, frontier = out, tuple(grown[i] for i in keep)
        most = max(most, len(states))
    return sum(states.values()), most


def _counted(graphs: DataFrame, count, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                edges = sorted((int(e["u"]), int(e["v"])) for e in r.edges)
                got, most = count(edges, *(int(getattr(r, c)) for c in columns))
                rows.append((r.graph_id, str(got), most))
            yield pd.DataFrame(rows, columns=["graph_id", "n", "states"])

    kind = graphs.schema["graph_id"].dataType.simpleString()
    whole = graphs.groupBy("graph_id", *columns).agg(F.collect_list(F.struct("u", "v")).alias("edges"))
    return whole.mapInPandas(run, f"graph_id {kind}, n string, states long").withColumn("n", F.col("n").cast("decimal(38,0)"))


def simple_path_counts(graphs: DataFrame) -> DataFrame:
    """(graph_id, n, states): the simple paths from s to t of each graph of graphs(graph_id, s, t, u, v), a row for each edge. Edges are taken in order, which keeps the
    frontier of a grid that is numbered by rows as short as a row."""
    return _counted(graphs, count_paths, ["s", "t"])


def flat_counts(graphs: DataFrame) -> DataFrame:
    """(graph_id, n, states): the partitions into connected blocks of each graph of graphs(graph_id, u, v)."""
    return _counted(graphs, count_flats, [])
