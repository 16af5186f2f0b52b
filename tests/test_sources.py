import json

import pytest

from weft.sources.arff import read_arff, write_arff
from weft.sources.graph_json import read_adjacency, read_lines, stored, write_lines


def test_arff_round_trip(spark, tmp_path):
    rows = [("a", 1.5, "yes"), ("b", None, "no"), ("a", -2.0, None)]
    df = spark.createDataFrame(rows, "kind string, size double, class string")
    write_arff(df, f"{tmp_path}/out")
    back = read_arff(spark, f"{tmp_path}/out")
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_arff_header_and_odd_lines(spark, tmp_path):
    path = tmp_path / "x.arff"
    path.write_text("% note\n@RELATION r\n@ATTRIBUTE 'first one' {p, q}\n@attribute n NUMERIC\n@DATA\np, 3\n# c\n\nz,4\nq,?\n")
    assert [tuple(r) for r in read_arff(spark, str(path)).collect()] == [("p", 3.0), ("q", None)]
    assert read_arff(spark, str(path), known_only=False).count() == 3
    (tmp_path / "none.arff").write_text("p,q\n")
    with pytest.raises(ValueError):
        read_arff(spark, str(tmp_path / "none.arff"))


def test_adjacency_drops_pendant_nodes(spark, tmp_path):
    near = {0: [1, 2], 1: [0, 2], 2: [0, 1, 3], 3: [2]}
    doc = {"nodes": [{"id": k, "C_X": float(k), "C_Y": -float(k)} for k in near], "adjacency": [[{"id": n} for n in v] for v in near.values()]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = read_adjacency(spark, str(tmp_path / "g.json"), "C_X", "C_Y")
    assert sorted((r.node_id, r.x, r.y) for r in g.nodes.collect()) == [(0, 0.0, -0.0), (1, 1.0, -1.0), (2, 2.0, -2.0)]
    assert sorted((r.u, r.v) for r in g.edges.collect()) == [(0, 1), (0, 2), (1, 2)]


def test_stored_and_lines(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert stored(spark, f"{tmp_path}/t", make).count() == stored(spark, f"{tmp_path}/t", make).count() == 3 and len(made) == 1
    df = spark.createDataFrame([(1, [1.5, None], "x\ny")], "a long, b array<double>, c string")
    write_lines(df, f"{tmp_path}/l")
    assert read_lines(spark, f"{tmp_path}/l", "a long, b array<double>, c string").collect() == df.collect()
