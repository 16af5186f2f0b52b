"""Columns beside those that are read, of names that the operators use themselves, pass through unchanged; ids may be strings."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

EXTRA = ["both", "_both", "__key", "c0", "c1", "key", "gone", "other_id", "_n", "_lang", "_d", "_full", "score", "predicted", "held_out", "matches", "place", "n", "comp", "Node", "rank", "__text"]
TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def rows():
    return [(k, f"{TEXT}\nline {k} of its own words {k}{k}" if k % 3 else TEXT, "en", f"s{k % 2}", *[f"{c}{k}" for c in EXTRA]) for k in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA)).cache()


def extras(df):
    return sorted(tuple(r[c] for c in ["doc_id", *EXTRA]) for r in df.collect())


def test_names(spark, docs):
    from weft.llm.decontaminate import decontaminate
    from weft.llm.jaccard_join import one_of_each
    from weft.llm.line_dedup import dedup_lines
    from weft.llm.mixing import mix
    from weft.llm.pii import pseudonymise
    from weft.llm.toxicity import drop_toxic, toxicity_model

    whole = extras(docs)
    model = toxicity_model(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    for got in (drop_toxic(docs, model), dedup_lines(docs), pseudonymise(docs, key="k"), decontaminate(docs, spark.createDataFrame([(1, "absent")], "item_id long, text string"))):
        assert got.columns == docs.columns and extras(got) == whole
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and set(extras(kept)) < set(whole)
    assert set(extras(mix(docs, docs["source"]))) <= set(whole)


def test_string_ids_order_lines(spark):
    from weft.llm.line_dedup import dedup_lines

    docs = spark.createDataFrame([("b", TEXT), ("a", f"{TEXT}\nx"), (None, "x"), ("c", None)], "doc_id string, text string").withColumn("N_LINES", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("mine"))
    got = dedup_lines(docs, counts=True)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == {"b": ("", 1, 1), "a": (TEXT, 2, 1), None: ("x", 1, 0), "c": (None, 0, 0)}


def test_numerals_are_no_letters():
    from weft.llm.language_id import learn

    model = learn({"en": ["the words of a text"], "de": ["die wörter eines textes"]})
    assert model.predict("½ ② ① 17 ⅷ") == ("und", 0.0)
