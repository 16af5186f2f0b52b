import hashlib
import random
import re

import pytest

from weft.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=13):
    wins = {}
    for i, t in items:
        w = split(t)
        if w:
            for k in range(max(1, len(w) - width + 1)):
                wins.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    sizes = {len(w) for w in wins}
    for d, t, *_ in docs:
        w, hit, ids = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= got
        yield d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def fixture(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices("a b c dé E9".split(), k=rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)] + [(50, None), (51, "--"), (3, "x y"), (7, "zz " * 14)]
    docs = []
    for d in range(150):
        parts = [rng.choice([" ".join(rng.choices("a b c dé e9 q r".split(), k=rng.randint(0, 30))), rng.choice(items)[1] or "", "zz " * 20]) for _ in range(rng.randint(0, 5))]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(parts), "k"))
    return [*docs, (500, None, "k"), (501, "", "k"), (1, docs[1][1], "k"), (502, "filler word " * 100_000 + (items[3][1] or ""), "k"), (503, "A-B_c" * 3, "k")], items


@pytest.mark.parametrize("seed,block_bytes,shard,held", [(1, 1 << 20, 1 << 18, 4), (2, 40, 1 << 18, 100), (3, 1 << 20, 50, 4), (4, 150, 1 << 18, 2)])
def test_against_brute_force(spark, monkeypatch, seed, block_bytes, shard, held):
    docs, items = fixture(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "SHARD_SUFFIXES", shard)
    monkeypatch.setattr(D, "BLOCKS_HELD", held)
    monkeypatch.setattr(D, "WINDOWS_AT_ONCE", 7)
    got = D.find_contamination(df, bench, block_bytes=block_bytes).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(brute(docs, items))
    texts = dict(d[:2] for d in docs)
    by_id = {}
    for i, t in items:
        by_id.setdefault(str(i), []).append(split(t))
    for r in got:
        w = split(texts[r.doc_id])
        for m in r.matches:
            assert any(w[m.doc_word : m.doc_word + m.n_words] == t[m.item_word : m.item_word + m.n_words] != [] for t in by_id[m.item_id])
    kept = D.decontaminate(df, bench, block_bytes=block_bytes)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.contaminated)


def test_longest_matches(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"x {text} y {text}")], "doc_id long, text string")
    [row] = D.find_contamination(docs, spark.createDataFrame([(9, text)], "item_id long, text string")).collect()
    assert sorted((m.item_word, m.doc_word, m.n_words) for m in row.matches) == [(0, 1, 40), (0, 42, 40)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in D.find_contamination(docs, none).collect()] == [(2, 0, 0)]
    assert D.find_contamination(docs.limit(0), none).count() == 0


def test_clashing_names_null_items_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCKS_HELD", 1)
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, "x", 1, 2), (1, text, "x", 1, 2), (None, "fine words", "y", 3, 4), (2, None, None, 5, 6)], "`doc_id` long, text string, `__text` string, at long, items long")
    bench = spark.createDataFrame([(None, text), (4, "other " * 3), (None, "w0"), (6, None)], "item_id long, text string")
    for size in (1 << 20, 5):
        got = D.find_contamination(docs, bench, block_bytes=size).orderBy("doc_id").collect()
        assert [(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in got] == [(None, 0, 0, False), (1, 20, 1, True), (1, 20, 1, True), (2, 0, 0, False)]
        assert got[1].items_sha256 == hashlib.sha256(b"").hexdigest()
        kept = D.decontaminate(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(None, "fine words", "y", 3, 4), (2, None, None, 5, 6)], key=str)
