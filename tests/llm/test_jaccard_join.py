import random
import re

import pytest

from weft.llm._setjoin import Threshold
from weft.llm.jaccard_join import jaccard_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, num=85, den=100):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    root[find(a)] = find(b)
    ids = {}
    for k, r in enumerate(rows):
        if r[0] is not None and (k0 := find(k)) is not None:
            ids[k0] = min(ids.get(k0, r[0]), r[0])
    return sorted(((r[0], len(sets[k]), ids.get(find(k)) if sets[k] else r[0]) for k, r in enumerate(rows)), key=str)


def near_copies(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["É", "the", "The"]
    rows = []
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 12, 40, 80, 180]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.randrange(len(copy) or 1)
                copy[k : k + 1] = rng.choice([[], ["x"], [rng.choice(vocabulary)], [*copy[k : k + 1], "y"]])
            rows.append((len(rows) * 7 % 1009, " ".join(copy).upper() if rng.random() < 0.2 else rng.choice(["  ", "\n", "\t"]).join(copy), "k"))
    rng.shuffle(rows)
    return [*rows, (2000, None, "k"), (2001, " \n", "k"), (2002, "", "k"), rows[0], (None, rows[1][1], "k"), (None, "all alone in here", "k"), (2003, "long text " * 60_000, "k"), (2004, "long text " * 60_000 + "end", "k")]


@pytest.mark.parametrize("seed,hot_rows,few,rounds", [(1, 1 << 17, 4, 8), (2, 1 << 17, 0, 3), (3, 2, 0, 0), (4, 8, 0, 2)])
def test_against_brute_force(spark, seed, hot_rows, few, rounds):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    got = jaccard_classes(df, hot_rows=hot_rows, few=few, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_chain_and_groups_of_copies(spark):
    words = [f"c{k}" for k in range(90)]
    rows = [(k, " ".join([*(f"z{j}" for j in range(k)), *words[k:]]), "") for k in range(0, 30)] + [(100 + k, " ".join(words), "") for k in range(50)]
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()
    assert {r.component_id for r in got} == {0} and sorted(map(tuple, got)) == sorted(brute(rows))


def test_empty_table(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefix_length_holds_for_all_sizes():
    for t in (Threshold(85, 100), Threshold(4, 5)):
        for a in range(1, 60):
            for b in range(1, a + 1):
                least = next(c for c in range(a + 1) if t.den * c >= t.num * (a + b - c))
                assert t.overlap(a + b) == least
                if least <= b:
                    assert t.prefix(a) >= a - least + 1 and t.prefix(b) >= b - least + 1


def test_components_by_rounds_and_in_a_task(spark):
    from weft.llm._setjoin import components
    from weft.llm._spark import Stored

    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1100)]
    store = Stored(spark, "test")
    stored = store.write(spark.createDataFrame(links, "node long, other long"), "links")
    one, many = (sorted(map(tuple, components(stored, store, name, limit).collect())) for name, limit in (("one", 1000), ("many", 0)))
    assert one == many and dict(one)[1100] == 1000
