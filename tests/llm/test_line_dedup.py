import random
import re

import pytest

from weft.llm.line_dedup import dedup_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_set(line):
    return frozenset(WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)))


def brute(rows):
    lines = []
    for r in rows:
        for k, x in enumerate((r[1] or "").split("\n")):
            if s := line_set(x):
                lines.append(((r[0] is not None, r[0] or 0, k), s))
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        own = r[1].split("\n")
        kept = []
        for k, x in enumerate(own):
            s, at = line_set(x), (r[0] is not None, r[0] or 0, k)
            if not s or not any(p < at and 5 * len(s & o) >= 4 * len(s | o) for p, o in lines):
                kept.append(x)
        out.append((r[0], "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


def corpus(seed, far=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "The", "of", "é"]
    pool = [rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 6, 9, 15, 40, 70, 160])) for _ in range(40)]
    rows = []
    for d in range(70):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(pool)) if rng.random() < 0.7 else rng.choices(vocabulary, k=12)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(line) or 1)
                line[k : k + 1] = rng.choice([[], ["x"], [rng.choice(vocabulary)], [*line[k : k + 1], "y"]])
            lines.append(rng.choice([" ", "  "]).join(line))
        rows.append(((d * 13 % 71) * far, "\n".join(lines), "s"))
    return [*rows, (90, None, "s"), (91, "", "s"), (92, "\n \n", "s"), rows[3], (rows[4][0], rows[5][1], "s"), (None, rows[6][1], "s"), (93, "\n".join(f"many words l{k} m{k} n{k}" for k in range(3000)) + "\n" + "long " * 50_000, "s")]


@pytest.mark.parametrize("seed,hot_rows,far", [(1, 1 << 17, 1), (2, 2, 1), (3, 8, 1 << 55)])
def test_against_brute_force(spark, seed, hot_rows, far):
    rows = corpus(seed, far)
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3), counts=True, hot_rows=hot_rows).drop("node").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_family_of_near_copies_and_columns(spark):
    words = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join([*words[: k % 60], f"u{k}", *words[k % 60 + 1 :]]) + "\nOnly here " + str(k), k) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = dedup_lines(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.drop("n_chars").collect())) == sorted(r[:2] for r in brute(rows))


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
