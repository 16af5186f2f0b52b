"""Graphs as two DataFrames, nodes(node_id, ...) and edges(u, v, ...), and the plain operators on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def degree(self) -> DataFrame:
        """node_id and degree, 0 for nodes without edges."""
        ends = self.edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
        return self.nodes.select("node_id").join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def induced(self, keep: Column) -> Graph:
        """The nodes that ``keep`` holds for, and the edges between them."""
        nodes = self.nodes.where(keep)
        ids = nodes.select("node_id")
        edges = self.edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi")
        return Graph(nodes, edges.select(*self.edges.columns))

    def both_ways(self) -> DataFrame:
        """Half-edges (src, dst): each edge in both directions."""
        return self.edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(self.edges.select("v", "u"))


def normalise(edges: DataFrame) -> DataFrame:
    """Undirected simple edges: smaller end first, loops and repeats dropped."""
    return edges.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")).where("u < v").distinct()


def graph_from_adjacency(rows: DataFrame) -> Graph:
    """From rows(node_id, neighbours array): pendant nodes, of degree 1, are dropped once."""
    edges = normalise(rows.select(F.col("node_id").alias("u"), F.explode("neighbours").alias("v")))
    g = Graph(rows.drop("neighbours"), edges)
    pendant = g.degree().where("degree = 1").select("node_id")
    kept = Graph(g.nodes.join(pendant, "node_id", "left_anti"), g.edges)
    return kept.induced(F.lit(True))


def remove_edge(edges: DataFrame, a: int, b: int) -> DataFrame:
    """Edges less {a, b}, whichever way it is written."""
    return edges.where(~((F.least("u", "v") == min(a, b)) & (F.greatest("u", "v") == max(a, b))))


def smooth_node(edges: DataFrame, node: int) -> DataFrame:
    """Drops a node and joins its two least neighbours."""
    near = edges.where((F.col("u") == node) | (F.col("v") == node)).select(F.when(F.col("u") == node, F.col("v")).otherwise(F.col("u")).alias("x"))
    new = near.agg(F.slice(F.array_sort(F.collect_set("x")), 1, 2).alias("a")).where("size(a) = 2").select(F.col("a")[0].alias("u"), F.col("a")[1].alias("v"))
    return normalise(edges.where((F.col("u") != node) & (F.col("v") != node)).select("u", "v").union(new))


def dense_ids(rows: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """rows with their places 0, 1, .. in an order: range partitions are sorted by themselves and their sizes summed up, so that no
    task sees all rows. The order should be total; rows that tie get places in any order."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).checkpoint()
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_lo"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", (before - F.col("_lo")).alias("_shift"))
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_i") + F.col("_shift")).cast("long")).drop("_p", "_i", "_shift")
