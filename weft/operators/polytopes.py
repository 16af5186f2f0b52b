"""Polytopes in equational form, A x = b: matrices(matrix_id, i, j, v) and right sides(matrix_id, i, v) without zeros, bases as
subsets(matrix_id, subset_id, j) of columns. A subset is one small group; subsets are spread over the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.portable import random_unit


def _cycle_rows(edges: DataFrame, n_edges: int) -> DataFrame:
    """(i, j, v): for each edge e and each end of it, row 2e or 2e + 1: the other edges at that end, less e, less a slack."""
    ends = edges.select("edge_id", F.posexplode(F.array("u", "v")).alias("q", "node_id")).select("edge_id", "q", "node_id", (2 * F.col("edge_id") + F.col("q")).alias("i"))
    others = ends.select("node_id", F.col("edge_id").alias("j"))
    around = ends.join(others, "node_id").where("edge_id <> j").select("i", "j", F.lit(1.0).alias("v"))
    own = ends.select("i", F.col("edge_id").alias("j"), F.lit(-1.0).alias("v"))
    slack = ends.select("i", ((F.col("q") + 1) * n_edges + F.col("edge_id")).alias("j"), F.lit(-1.0).alias("v"))
    return around.union(own).union(slack)


def cycle_cone(edges: DataFrame, n_nodes: int) -> tuple[DataFrame, DataFrame]:
    """The cone of cycles of edges(edge_id from 0, u, v), cut where all variables sum to twice the number of nodes: (i, j, v) and (i, v)."""
    spark, m = edges.sparkSession, edges.count()
    total = spark.range(3 * m).select(F.lit(2 * m).cast("long").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    return _cycle_rows(edges, m).union(total), spark.range(1).select(F.lit(2 * m).cast("long").alias("i"), F.lit(2.0 * n_nodes).alias("v"))


def cycle_box(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same cone within the unit box instead: edge e and its slack sum to 1, in row 3m - 1 - e of m edges."""
    m = edges.count()
    bound = edges.select((F.lit(3 * m - 1) - F.col("edge_id")).alias("i"), F.explode(F.array(F.col("edge_id"), F.col("edge_id") + 3 * m)).alias("j"), F.lit(1.0).alias("v"))
    return _cycle_rows(edges, m).union(bound), edges.select((F.lit(3 * m - 1) - F.col("edge_id")).alias("i"), F.lit(1.0).alias("v"))


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The columns' numbers and the matrix of their entries; entries without a row are of columns without entries."""
    j, column = np.unique(pdf["j"].to_numpy(), return_inverse=True)
    some = pdf["i"].notna().to_numpy()
    i, row = np.unique(pdf["i"].to_numpy()[some].astype(np.int64), return_inverse=True)
    a = np.zeros((len(i), len(j)))
    a[row, column[some]] = pdf["v"].to_numpy()[some]
    return j, a


def _rank(a: np.ndarray) -> int:
    return int(np.linalg.matrix_rank(a)) if a.size else 0


def independent(matrices: DataFrame, subsets: DataFrame, keys: tuple[str, ...] = ("subset_id",)) -> DataFrame:
    """(matrix_id, keys.., independent): whether the columns of a subset, which the keys tell, are linearly independent."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        j, a = _dense(pdf)
        return pd.DataFrame([(*key, _rank(a) == len(j))], columns=["matrix_id", *keys, "independent"])

    entries = subsets.join(matrices, ["matrix_id", "j"], "left")
    return entries.groupBy("matrix_id", *keys).applyInPandas(run, f"matrix_id long, {', '.join(f'{k} long' for k in keys)}, independent boolean")


def basic_solutions(matrices: DataFrame, right: DataFrame, subsets: DataFrame) -> DataFrame:
    """(matrix_id, subset_id, j, x): the solution that is 0 outside the subset, of subsets that are a basis: independent, and as many columns as the matrix has rows."""
    sizes = matrices.groupBy("matrix_id").agg(F.countDistinct("i").alias("n_rows"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # The right side comes along as column -1.
        j, a = _dense(pdf)
        b, a = (a[:, 0], a[:, 1:]) if j[0] == -1 else (np.zeros(len(a)), a)
        j, n = j[j >= 0], int(pdf["n_rows"].iloc[0])
        x = np.linalg.solve(a, b) if a.shape == (n, n) and _rank(a) == n else []
        return pd.DataFrame({"matrix_id": key[0], "subset_id": key[1], "j": j[: len(x)], "x": x})

    chosen = subsets.join(matrices, ["matrix_id", "j"], "left").select("matrix_id", "subset_id", "i", "j", "v")
    sides = subsets.select("matrix_id", "subset_id").distinct().join(right, "matrix_id").select("matrix_id", "subset_id", "i", F.lit(-1).cast("long").alias("j"), "v")
    return chosen.union(sides).join(sizes, "matrix_id").groupBy("matrix_id", "subset_id").applyInPandas(run, "matrix_id long, subset_id long, j long, x double")


def nonnegative(solutions: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(matrix_id, subset_id, feasible): whether no x is below 0."""
    return solutions.groupBy("matrix_id", "subset_id").agg((F.min("x") >= -tolerance).alias("feasible"))


def greedy_bases(matrices: DataFrame, orders: DataFrame) -> DataFrame:
    """(matrix_id, order_id, j): going through the columns of orders(matrix_id, order_id, pos, j), those that are independent of the ones kept before."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        j, a = _dense(pdf)
        at = {c: k for k, c in enumerate(j)}
        kept: list[int] = []
        for c in pdf.sort_values("pos")["j"].drop_duplicates():
            if _rank(a[:, [*kept, at[c]]]) > len(kept):
                kept.append(at[c])
        return pd.DataFrame({"matrix_id": key[0], "order_id": key[1], "j": j[kept]})

    return orders.join(matrices, ["matrix_id", "j"], "left").groupBy("matrix_id", "order_id").applyInPandas(run, "matrix_id long, order_id long, j long")


def drawn_orders(spark: SparkSession, columns: int, samples: int, seed: int = 1) -> DataFrame:
    """(sample_id, pos, j): uniform orders of the columns."""
    rows = spark.range(samples * columns).select(F.expr(f"id div {columns}").alias("sample_id"), F.expr(f"id % {columns}").alias("j"))
    w = Window.partitionBy("sample_id").orderBy(random_unit(seed, F.col("sample_id"), F.col("j")), "j")
    return rows.select("sample_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "j")


def first_basis(matrices: DataFrame, tries: DataFrame) -> DataFrame:
    """(matrix_id, sample_id, try, j): of tries(matrix_id, sample_id, try, j), each sample's first subset that is independent."""
    found = independent(matrices, tries, ("sample_id", "try")).where("independent")
    good = found.groupBy("matrix_id", "sample_id").agg(F.min("try").alias("try"))
    return tries.join(good, ["matrix_id", "sample_id", "try"]).select("matrix_id", "sample_id", "try", "j")


def edges_of(edges: DataFrame, solution: DataFrame, least: float = 1e-4) -> DataFrame:
    """(u, v) of the edges whose variable in solution(j, x) is over ``least``."""
    return edges.join(solution.where(F.col("x") > least).select(F.col("j").alias("edge_id")), "edge_id").select("u", "v")
