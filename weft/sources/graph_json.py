"""Graphs in adjacency JSON, and tables that are computed once and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, graph_from_adjacency


def read_adjacency(spark: SparkSession, path: str, x: str | None = None, y: str | None = None) -> Graph:
    """From a JSON object with ``nodes``, a list of objects with an id, and ``adjacency``, a list of lists of objects with an id, in the
    same order. Columns x and y, if named, become the positions; nodes with one neighbour are dropped."""
    doc = spark.read.option("multiLine", True).json(path)
    nodes = doc.select(F.posexplode("nodes").alias("pos", "n")).select("pos", F.col("n.id").cast("long").alias("node_id"), "n.*").drop("id")
    near = doc.select(F.posexplode("adjacency").alias("pos", "a")).select("pos", F.transform("a", lambda e: e["id"].cast("long")).alias("neighbours"))
    rows = nodes.join(near, "pos").drop("pos")
    for name, source in (("x", x), ("y", y)):
        if source:
            rows = rows.withColumn(name, F.col(source).cast("double"))
    return graph_from_adjacency(rows)


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, computed and written there first if it doesn't exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.parquet(path)
    return spark.read.parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, as text; read_lines() gives the rows back by schema, never by evaluating them."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")
