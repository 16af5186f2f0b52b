import random

import pytest

from weft.operators.frontier import count_flats, count_paths


def graph(seed):
    rng = random.Random(seed)
    n = rng.randint(3, 6)
    return n, sorted(e for e in {(a, b) for a in range(n) for b in range(a + 1, n)} if rng.random() < 0.7)


def near(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_random_graphs_against_enumeration(seed):
    n, edges = graph(seed)
    by = near(edges)

    def walk(k, seen):
        return 1 if k == n - 1 else sum(walk(x, seen | {x}) for x in by.get(k, ()) if x not in seen)

    assert count_paths(edges, 0, n - 1)[0] == walk(0, {0})
    found = set()
    for mask in range(1 << len(edges)):
        block = {k: k for k in by}
        for i, (a, b) in enumerate(edges):
            if mask >> i & 1:
                x, y = block[a], block[b]
                block = {k: x if v == y else v for k, v in block.items()}
        found.add(tuple(block[k] == block[x] for k in sorted(by) for x in sorted(by)))
    assert count_flats(edges)[0] == len(found)
