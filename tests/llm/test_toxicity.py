import random

import numpy as np

from weft.llm.toxicity import FEATURES, Weights, boost, copies, features, isotonic, score_toxicity, toxicity_model

WORDS = "river stone cloud paper window garden travel market yellow simple number before letter".split()


def corpus(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        toxic = i % 8 == 0
        words = rng.choices(WORDS, k=rng.randint(20, 60))
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilsch", "grumpf"]) + rng.choice(["", "er", "ing"]))
        yield i, " ".join(words), int(toxic)


def test_learns_and_scores_held_out_rows(spark):
    rows = list(corpus(900, 1))
    odd = [(5000, None, 0), (5001, "", 0), (5002, "... !!!", 0), (5000, "v-i-l-s-c-h you gr0mpf vilsch vilscher vilsching grumpf", 0), (None, "grumpf", 0), (5003, "vilsch grumpfer " * 50_000, 0)]
    docs = spark.createDataFrame([(a, b, "src") for a, b, _ in rows + odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(1, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    got = score_toxicity(docs, toxicity_model(docs, labels)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    want = {a: c for a, _, c in rows}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.98 * len(held) > 200
    assert [r.predicted for r in got if r.doc_id == 5003] == [1]
    assert all(r.predicted == 0 for r in got if r.doc_id in (5001, 5002))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score_toxicity(docs, toxicity_model(docs, labels)).collect()] == [0.0]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score_toxicity(none, toxicity_model(none, labels)).count() == 0


def test_obscured_words_hit():
    w = Weights({"grumpf$": 5.0})
    assert features("x gr*mpf y", w)[1] == 0 and features("so g r u m p f it is", w)[1] > 0
    assert features("you gru.mpf", w)[FEATURES.index("hits near second person")] > 0
    assert features("grumpffff", w)[1] > 0 and features(None, w) == [0.0] * len(FEATURES)


def test_isotonic_rises_and_trees_fit():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 1] > 0.6).astype(float)
    raw = boost(x, y).raw(x)
    assert ((raw > 0) == (y > 0)).mean() > 0.98
    at, p = isotonic(raw, y)
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1


def test_copies_share_a_number():
    rng = random.Random(4)
    a = [f"w{rng.random()}" for _ in range(80)]
    b = [*a[:40], "changed", *a[41:]]
    got = copies([" ".join(a), " ".join(b), " ".join(f"z{rng.random()}" for _ in range(80)), " ".join(a)])
    assert got[0] == got[1] == got[3] != got[2]
