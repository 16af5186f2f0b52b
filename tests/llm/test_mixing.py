import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from weft.llm.mixing import budgets, default_domain, default_weights, mix, oracle_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def flow(leaves, weights, budget, max_epochs):
    """Budgets by the plain recursion: children's shares by weight, the full ones first."""
    got = {}

    def go(path, budget):
        depth = len(path)
        mine = [leaf for leaf in leaves if leaf[:depth] == path]
        if depth == 3:
            got[path] = budget
            return
        cap = {k: sum(leaves[x] for x in mine if x[depth] == k) * max_epochs for k in {x[depth] for x in mine}}
        w = {k: weights.get(path + (k,), 1) for k in cap}
        left, alive, share = budget, {k for k in cap if w[k] > 0}, dict.fromkeys(cap, 0)
        while alive:
            total = sum(w[k] for k in alive)
            full = {k for k in alive if cap[k] * total <= left * w[k]}
            if not full:
                for k in alive:
                    share[k] = min(cap[k], left * w[k] // total)
                break
            for k in full:
                share[k] = cap[k]
            left -= sum(cap[k] for k in full)
            alive -= full
        for k in cap:
            go(path + (k,), share[k])

    go((), budget)
    return got


def test_budgets_against_recursion(spark):
    rng = random.Random(6)
    for _ in range(4):
        leaves = {(rng.choice("AB"), rng.choice("xyz"), rng.choice("pqrs")): rng.choice([0, 1, 10, 300, 5000]) for _ in range(14)}
        weights = {("A",): 5, ("B",): rng.choice([0, 1]), ("A", "x"): 3, ("A", "y", "p"): 0}
        budget = rng.choice([0, 7, 900, 10**6])
        frame = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
        w = spark.createDataFrame([(*k, *[None] * (3 - len(k)), v) for k, v in weights.items()], "domain string, lang string, source string, weight long")
        got = {(r.domain, r.lang, r.source): int(r.got) for r in budgets(frame, w, budget, 2).collect()}
        want = {k: v for k, v in flow(leaves, weights, budget, 2).items() if k in got}
        assert got == want and sum(got.values()) == sum(flow(leaves, weights, budget, 2).values())


def rows(seed, n=200):
    rng = random.Random(seed)
    out = [(k, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["en", "de", None]), rng.choice(["src1", "src1", "src1", "src2", "src5", "odd", None]), "t") for k in range(n)]
    return [*out, out[3], out[4], (500, None, "en", "src1", "t"), (None, "a b", "en", "src1", "t"), (501, "long word " * 100_000, "fr", "src3", "t")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_duckdb(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, epoch string")
    got = mix(df, default_domain(F.col("source")), default_weights(spark), buckets=8)
    assert got.columns == ["doc_id", "text", "lang", "source", "domain", "n_tokens", "epoch"]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, epoch VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?)", data)
    want = con.execute(oracle_sql("d").replace("SELECT doc_id, lang0 AS lang, source0 AS source, domain, n_tokens", "SELECT doc_id, lang0, source0, domain, n_tokens")).fetchall()
    assert sorted(map(tuple, got.drop("text").collect()), key=str) == sorted(want, key=str)


def test_prefix_of_an_epoch(spark):
    data = [(k, "w w w", "en", "src0") for k in range(100)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    for share, n in [((1, 2), 50), ((3, 2), 150), ((1, 1), 100), ((5, 1), 300)]:
        got = mix(df, F.lit("d"), share=share, max_epochs=3, buckets=16).collect()
        assert len(got) == n
    first = [k for k, *_ in sorted(data, key=lambda r: int(hashlib.md5(f"7|0|{r[0]}".encode()).hexdigest()[:15], 16))[:50]]
    assert {r.doc_id for r in mix(df, F.lit("d"), share=(1, 2), buckets=16).collect()} == set(first)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mix(none, F.lit("d")).count() == 0
