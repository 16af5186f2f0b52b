import random

import pytest
from test_decontaminate import brute as contaminated
from test_jaccard_join import brute as classes
from test_line_dedup import brute as line_dedup

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(400)]
    line = lambda n=12: " ".join(rng.choices(vocabulary, k=n)) + "."
    shared, passage = line(60), " ".join(rng.choices(vocabulary, k=20))
    out = []
    for k in range(240):
        text = "\n".join(line() for _ in range(rng.randint(1, 6)))
        if k % 8 == 0:
            text += "\n" + " ".join(rng.choice(["vilsch", "grumpf"]) + rng.choice(["er", "ing"]) + " " + rng.choice(vocabulary) for _ in range(5))
        if k % 10 == 3:
            text += f"\n{shared} more{k}"
        if k % 30 == 5:
            text = f"{text}\n{passage}"
        if k % 20 == 7:
            text = out[-3][1]
        out.append((k, text, rng.choice(["en", "de"]), f"src{k % 5}", len(text)))
    return out, passage


def test_stages_against_brute_force(spark, tmp_path):
    rows, passage = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 8 == 0)) for r in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, passage)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append(sorted(map(tuple, docs.select("doc_id", "text", "lang", "source", "n_chars").collect())))
        if k < 4:
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    toxic, lines, near, clean, mixed = seen
    assert not [r for r in toxic if r[0] % 8 == 0 and r[0] % 20 != 7] and len(toxic) >= 200
    assert [r[:2] for r in lines] == [(d, t) for d, t, *_ in line_dedup(toxic)] or sorted(r[:2] for r in lines) == sorted(r[:2] for r in line_dedup(toxic))
    assert all(r[4] == len(r[1]) for r in lines)
    group = {d: c for d, _, c in classes(lines)}
    assert [r[0] for r in near] == sorted(d for d, c in group.items() if d == c)
    bad = {d for d, *_, c in contaminated(near, items) if c}
    assert bad and clean == [r for r in near if r[0] not in bad]
    assert mixed and set(mixed) <= set(clean)
    assert sorted(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()) == [r[0] for r in mixed]


def test_near_copies_of_repeated_and_null_rows(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [(5, text), (5, text), (3, text + " x"), (None, text), (None, "other words of its own here"), (None, "other words of its own here"), (7, None), (8, ""), (7, None), (9, "short")]
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, text + " x"), (None, "other words of its own here"), (7, None), (7, None), (8, ""), (9, "short")], key=str)
