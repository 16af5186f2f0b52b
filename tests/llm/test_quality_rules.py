import itertools
import random
from collections import Counter

from weft.llm.quality_rules import judge, line_verdict, quality_rules, repeated_words


def brute_repeats(words):
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(wins)
    return len(set(itertools.chain.from_iterable(range(i, i + 5) for i, w in enumerate(wins) if n[w] > 1)))


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = rng.choices("abcd"[: rng.randint(1, 4)], k=rng.randint(0, 40))
        assert repeated_words(words) == brute_repeats(words)


def test_rules_on_lines():
    for line, rule in [
        ("A plain sentence of some words, as usual.", None), ("BUY THE NEW THING RIGHT NOW TODAY", "boilerplate"), ("Home | News | Sport | About", "navigation"),
        ("so!! much!! noise!! here!!", "punctuation"), ("a### b*** c$$$ d", "symbols"), ("Please accept cookies to go on", "boilerplate"), ("he he he he she she she she it", "stutter"), ("+1 (555) 555-1234", None),
    ]:
        assert line_verdict(line, line.split()) == rule, line


def test_documents(spark):
    clean = "\n".join(f"Here{i} is a w{i} x{i} of y{i} in z{i}." for i in range(20))
    rows = [(1, clean, "x"), (2, None, "x"), (3, "", "x"), (4, "Home | News | Sport | About\n" * 20, "x"), (5, clean + "\nHome | News | Sport | About", "x"), (1, clean, "y"), (6, "word " * 200_000, "z")]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].kept and by[1].clean_text == clean and by[1].lost_chars == 0
    assert not by[2].kept and by[2].n_words == 0 and by[2].base_failed and not by[3].kept
    assert not by[4].kept and by[4].n_dup_lines == 19
    assert by[5].kept and by[5].clean_text == clean
    assert by[6].base_failed and by[6].n_words == 200_000 == by[6].n_repeat_words
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_base_figures():
    j = judge("a\tbé c\n\na\tbé c\n#x ")
    assert (j["n_words"], j["word_chars"], j["n_symbols"], j["n_dup_lines"], j["n_repeat_words"]) == (7, 10, 1, 1, 0)
