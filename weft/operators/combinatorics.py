"""Exact counting formulas as folds over short sequences."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binomials(spark: SparkSession, n: int) -> DataFrame:
    """(k, c): binomial coefficients n over k, for n of 60 at most, where the products stay below 2**63."""
    if n > 60:
        raise ValueError("n over 60 needs more than 63 bits")
    fold = F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest("k", F.lit(1)) - 1), F.lit(1).cast("long"), lambda c, i: F.when(F.col("k") == 0, c).otherwise(F.call_function("div", c * (F.lit(n) - i), i + 1)))
    return spark.range(n + 1).select(F.col("id").alias("k")).select("k", fold.alias("c"))


def central_binomials(spark: SparkSession, most: int) -> DataFrame:
    """(m, c): (2m)! / (m!)**2 for m up to ``most`` (60 at most), as DECIMAL(38,0): each is the one before times (4m - 2) / m."""
    fold = F.aggregate(F.sequence(F.lit(1), F.greatest("m", F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda c, i: F.when(F.col("m") == 0, c).otherwise(F.floor(c * (4 * i - 2) / i).cast("decimal(38,0)")))
    return spark.range(most + 1).select(F.col("id").cast("int").alias("m")).select("m", fold.alias("c"))


def ratio_families(spark: SparkSession, m: int) -> DataFrame:
    """(family, k, d, v): the entries (2dk)! / ((dk)! (dk - m)!), family 1, for d from
    m + 3 to 2m + 2 and k from 1 to m - 3, and 4 ** (dk), family 2, for d from 3 to m + 2 and k from 1 to m; doubles."""
    rows = lambda lo, hi, most: spark.range(lo, hi).select(F.col("id").alias("d")).crossJoin(F.broadcast(spark.range(1, most + 1).select(F.col("id").alias("k"))))
    n = F.col("d") * F.col("k")
    # (2n)! / (n! (n - m)!) is the product of n + 1 .. 2n over (n - m)!: factor by factor, so that nothing overflows early.
    low = F.aggregate(F.sequence(F.lit(1), (n - m).cast("int")), F.lit(1.0), lambda c, i: c * (n + m + i) / i)
    high = F.aggregate(F.sequence(F.lit(1), F.lit(m)), F.lit(1.0), lambda c, i: c * (n + i))
    one = rows(m + 3, 2 * m + 3, max(0, m - 3)).select(F.lit(1).alias("family"), "k", "d", (low * high).alias("v"))
    two = rows(3, m + 3, m).select(F.lit(2).alias("family"), "k", "d", F.pow(F.lit(4.0), n.cast("double")).alias("v"))
    return one.union(two)


def shifted_binomials(spark: SparkSession, k_most: int, r_most: int, d_most: int) -> DataFrame:
    """(k, r, d, v): C(2dk, dk + r) for k of 1 to k_most, r of 0 to r_most - 1 and d from r_most to d_most - 1; doubles."""
    rows = spark.range(r_most, d_most).select(F.col("id").alias("d")).crossJoin(F.broadcast(spark.range(1, k_most + 1).select(F.col("id").alias("k")))).crossJoin(F.broadcast(spark.range(r_most).select(F.col("id").alias("r"))))
    n = F.col("d") * F.col("k")
    fold = F.aggregate(F.sequence(F.lit(1).cast("long"), n - F.col("r")), F.lit(1.0), lambda c, i: c * (n + F.col("r") + i) / i)
    return rows.select("k", "r", "d", fold.alias("v"))


def stationary_weights(spark: SparkSession, n: int) -> DataFrame:
    """(k, weight): (n - k)!, the weight of a partition of n nodes into k colours, as DECIMAL(38,0); n of 33 at most."""
    fold = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(n) - F.col("k"), F.lit(1)).cast("int")), F.lit(1).cast("decimal(38,0)"), lambda c, i: (c * i).cast("decimal(38,0)"))
    return spark.range(n + 1).select(F.col("id").cast("int").alias("k")).select("k", fold.alias("weight"))


def clear_right(matrices: DataFrame) -> DataFrame:
    """Column elimination without pivoting of each matrix_id of matrices(matrix_id, i, j, v), square, in exact fractions: columns right of i lose their multiple of
    column i, for i = 0, 1, ..; where a pivot is 0, what would be divided by it is null. Absent entries are 0; a matrix is one row on its way."""

    def eliminate(entries) -> list[tuple]:
        m = max(max(e["i"], e["j"]) for e in entries) + 1
        a = [[Fraction(0)] * m for _ in range(m)]
        for e in entries:
            a[e["i"]][e["j"]] = Fraction(e["v"])
        for i in range(m):
            if a[i][i] == 0:
                for row in a:
                    row[i + 1 :] = [None] * (m - i - 1)
                break
            for k in range(i + 1, m):
                q = a[i][k] / a[i][i]
                for row in a:
                    row[k] -= q * row[i]
        return [(i, j, None if x is None else float(x)) for i, row in enumerate(a) for j, x in enumerate(row)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *x) for k, entries in zip(pdf["matrix_id"], pdf["entries"], strict=True) for x in eliminate(entries)]
            yield pd.DataFrame(rows, columns=["matrix_id", "i", "j", "v"])

    whole = matrices.groupBy("matrix_id").agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v"))).alias("entries"))
    return whole.mapInPandas(run, f"matrix_id {matrices.schema['matrix_id'].dataType.simpleString()}, i int, j int, v double")


def diagonal_bound(a: DataFrame, b: DataFrame, factor: float = 2.0) -> DataFrame:
    """(matrix_id, holds): whether each diagonal entry of a is ``factor`` times that of b at most; of (matrix_id, i, j, v)."""
    pick = lambda x, name: x.where("i = j").select("matrix_id", "i", F.col("v").alias(name))
    return pick(a, "v_a").join(pick(b, "v_b"), ["matrix_id", "i"]).groupBy("matrix_id").agg(F.bool_and(F.col("v_a") <= factor * F.col("v_b")).alias("holds"))
