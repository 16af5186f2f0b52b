import itertools
import random
import time

import numpy as np

from weft.llm.language_id import identify, language_model, learn, script

EN = "the quick brown fox jumps over the lazy dog and then they went home with all their things"
DE = "der schnelle braune fuchs springt über den faulen hund und dann gingen sie nach hause mit sachen"
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом они пошли домой со своими вещами"


def brute_path(scores, penalty):
    n, langs = scores.shape
    return max(itertools.product(range(langs), repeat=n), key=lambda p: round(sum(scores[k, x] for k, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])), 9))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    model = learn({"en": [EN], "de": [DE], "ru": [RU]})
    value = lambda p, s: sum(s[k, x] for k, x in enumerate(p)) - model.penalty * sum(a != b for a, b in zip(p, p[1:]))
    for penalty in (0.5, 2.0, 5.0):
        model.penalty = penalty
        for _ in range(60):
            s = -rng.random((rng.integers(1, 7), 3)) * 6
            assert abs(value(model.path(s).tolist(), s) - value(brute_path(s, penalty), s)) < 1e-9


def test_spans_of_mixed_text_and_scripts():
    model = learn({"en": [EN] * 3, "de": [DE] * 3, "ru": [RU] * 3})
    text = f"{EN} {DE} {RU}"
    spans = model.spans(text)
    assert [model.langs[x] for *_, x in spans] == ["en", "de", "ru"]
    assert text[spans[2][0] : spans[2][1]] == RU
    assert model.predict(None) == model.predict("12 %") == ("und", 0.0)
    assert [script(c) for c in "aßжא한あ漢"] == ["latin", "latin", "cyrillic", "hebrew", "hangul", "kana", "han"]


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(t.split(), k=12)), lang, "x") for i in range(300) for lang, t in [[("en", EN), ("de", DE), ("ru", RU)][i % 3]]]
    odd = [(1000, None, "en", "x"), (1001, "", None, "x"), (1001, "123", "de", "x"), (None, EN, "en", "x"), (1002, "word " * 100_000 + EN, "en", "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = identify(docs, language_model(docs, per_language=50)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    want = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) > 0.97 * len(held) > 60
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001)} == {"und"}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(empty, language_model(empty)).count() == 0
    assert {r.lang_pred for r in identify(docs, language_model(empty)).collect()} == {"und"}


def test_long_runs_are_read_to_their_end():
    model = learn({"aa": ["abab baba abba baab"] * 5, "zz": ["yzyz zyzy yzzy zyyz"] * 5})
    text = "ab" * 120 + "yz" * 300
    assert model.predict(text)[0] == "zz" and model.spans(text) == [(0, 240, 0), (240, 840, 1)]


def test_runs_are_the_words_without_numerals():
    from weft.llm.language_id import WORD, letters, runs

    texts = ["", "½ ② ", "plain words", "é½è x²y ①a", "a" * 130 + "Ⅻ" + "b" * 61, "été 12 où", "漢字 かな ㊈ 語", "Ⅳ" * 70]
    texts += ["x" + chr(c) + "y" for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]
    for text in texts:
        assert runs(text) == WORD.findall(letters(text))


def plain_path(scores, penalty):
    value, back = scores[0].copy(), [None]
    for row in scores[1:]:
        top = int(value.argmax())
        stay = value >= value[top] - penalty
        back.append(np.where(stay, np.arange(len(row)), top))
        value = np.where(stay, value, value[top] - penalty) + row
    path = [int(value.argmax())]
    for b in back[:0:-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_paths_are_the_plain_ones_with_ties_and_take_less_time_than_a_step_a_word():
    rng = np.random.default_rng(7)
    model = learn({"en": [EN], "de": [DE], "ru": [RU]})
    for k in range(120):
        langs, n = int(rng.integers(2, 6)), int(rng.integers(1, 400))
        s = -rng.integers(0, 7, (n, langs)).astype(float)
        if k % 2:
            s[np.arange(n), np.repeat(rng.integers(0, langs, n), int(rng.integers(3, 40)))[:n]] = 0
        model.penalty = float(rng.choice([0, 1, 5, 12]))
        assert model._viterbi(s).tolist() == plain_path(s, model.penalty)
    s = -np.round(rng.random((20_000, 3)) * 6)
    s[np.arange(20_000), np.repeat([0, 1, 2, 0], 5_000)] = 0
    model.penalty, took = 12.0, []
    for run in (lambda: model.path(s).tolist(), lambda: plain_path(s, 12.0)):
        began = time.process_time()
        path = run()
        took.append(time.process_time() - began)
    assert path == model.path(s).tolist() and took[0] < took[1] / 3


def naive_score(model, word):
    padded, row = f"^{word}$", np.zeros(len(model.langs))
    for k in range(len(padded) - 2):
        row = row + model.logs[model.groups.get(padded[k : k + 3], len(model.logs) - 1)]
    row = row + model.words.get(word, 0)
    row[~model.scripts.get(script(word[0]), np.ones(len(row), dtype=bool))] = -np.inf
    return np.maximum(row - row.max(), -model.clip)


def test_scores_are_naive_ones_and_their_sums_exact():
    model = learn({"en": [EN] * 3, "de": [DE] * 3, "ru": [RU] * 3})
    words = ["the", "über", "быстрая", "x", "漢字", "qqqq", "zz" * 30, "𐐨𐐩", "the", "ab漢"]
    scores = model.score(words)
    assert np.abs(scores - [naive_score(model, w) for w in words]).max() < 2**-23
    assert (scores * 2**24 % 1 == 0).all() and (model.score(words[::-1]) == scores[::-1]).all()


def test_texts_scored_together_are_answered_as_alone(monkeypatch):
    rng = random.Random(5)
    model = learn({"en": [EN] * 3, "de": [DE] * 3, "ru": [RU] * 3})
    texts = [None, "", "12 ½", EN, DE + " " + RU, "q", *[" ".join(rng.choices(f"{EN} {DE} {RU}".split(), k=rng.randrange(200))) for _ in range(300)], f"{EN} " * 3000, RU, None]
    got = list(model.predict_all(iter(texts)))
    assert got == [model.predict(t) for t in texts]
    monkeypatch.setattr("weft.llm.language_id.GROUP_SCORES", 21)
    fresh = learn({"en": [EN] * 3, "de": [DE] * 3, "ru": [RU] * 3})
    assert list(fresh.predict_all(texts)) == got and (fresh.score([*"abcdefghij"]) == model.score([*"abcdefghij"])).all()
    monkeypatch.undo()
    many = [f"{EN} " + "".join(chr(97 + n // 26**i % 26) for i in range(5)) for n in range(1500)]
    want = [model.predict(t) for t in many]
    model._row.clear()
    model.predict("zyxwv the")
    model._memo = model._memo[:10]  # full: what was scored is forgotten
    assert list(model.predict_all(many)) == want and "zyxwv" not in model._row
