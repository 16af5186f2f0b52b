"""Planar graphs with node positions: rotation systems, faces, duals and refinements over a half-edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph, dense_ids, normalise


def rotation(g: Graph) -> DataFrame:
    """(src, dst, next): after dst, the next neighbour of src clockwise, by angle; nodes(node_id, x, y) give positions."""
    at = g.nodes.select("node_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    half = g.both_ways().join(at.select(F.col("node_id").alias("src"), F.col("px").alias("sx"), F.col("py").alias("sy")), "src")
    half = half.join(at.select(F.col("node_id").alias("dst"), F.col("px").alias("dx"), F.col("py").alias("dy")), "dst")
    half = half.withColumn("angle", F.atan2(F.col("dx") - F.col("sx"), F.col("dy") - F.col("sy")))
    w = Window.partitionBy("src").orderBy("angle", "dst")
    first = F.first("dst").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return half.select("src", "dst", F.coalesce(F.lead("dst").over(w), first).alias("next"))


def half_edge_steps(g: Graph) -> DataFrame:
    """(src, dst, to_dst): along a face, the half-edge (src, dst) is followed by (dst, to_dst)."""
    return rotation(g).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("next").alias("to_dst"))


def faces(g: Graph) -> DataFrame:
    """(face, src, dst): the face to which each half-edge belongs, named by its least half-edge (src * 2**31 + dst).

    Orbits of a permutation by pointer doubling: after k rounds a half-edge knows the least of the 2**k that follow it, so
    the longest face, of n half-edges, takes log2(n) + 1 rounds, whatever the number of faces.
    """
    code = lambda a, b: F.col(a) * F.lit(1 << 31) + F.col(b)
    table = half_edge_steps(g).select(code("src", "dst").alias("h"), code("dst", "to_dst").alias("to")).withColumn("least", F.least("h", "to"))
    known = 0
    while True:
        other = table.select(F.col("h").alias("to"), F.col("to").alias("far"), F.col("least").alias("its"))
        table = table.join(other, "to").select("h", F.col("far").alias("to"), F.least("least", "its").alias("least")).checkpoint()
        n = table.select("least").distinct().count()
        if n == known:
            break
        known = n
    return table.select(F.col("least").alias("face"), F.expr(f"h div {1 << 31}").alias("src"), F.expr(f"h % {1 << 31}").alias("dst"))


def bounded_faces(g: Graph, found: DataFrame | None = None) -> DataFrame:
    """(face, length, area2, cx, cy): the faces with positive signed area, walked with the interior on one side; cx, cy average the corners."""
    at = g.nodes.select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    f = (found if found is not None else faces(g)).join(at.select(F.col("node_id").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0")), "src").join(at.select(F.col("node_id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1")), "dst")
    area = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0"))
    return f.groupBy("face").agg(F.count("*").alias("length"), area.alias("area2"), F.avg("x0").alias("cx"), F.avg("y0").alias("cy")).where("area2 > 0")


def dual(g: Graph, restricted: bool = True) -> DataFrame:
    """(a, b, u, v): faces a < b that share the primal edge {u, v}; restricted to bounded faces, or all."""
    f = faces(g)
    if restricted:
        f = f.join(bounded_faces(g, f).select("face"), "face", "left_semi")
    one = f.select(F.col("face").alias("a"), F.col("src").alias("u"), F.col("dst").alias("v"))
    other = f.select(F.col("face").alias("b"), F.col("dst").alias("u"), F.col("src").alias("v"))
    return one.join(other, ["u", "v"]).where("a < b").select("a", "b", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def cut_to_dual(dual_edges: DataFrame, cut: DataFrame) -> DataFrame:
    """The dual edges whose primal edge is cut, whichever way it is written."""
    return dual_edges.join(normalise(cut), ["u", "v"], "left_semi").select("a", "b", "u", "v")


def edge_refine(g: Graph) -> Graph:
    """A node in the middle of every edge."""
    at = g.nodes.select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    top = at.agg(F.max("node_id")).first()[0] or 0
    e = dense_ids(g.edges.select("u", "v"), "u", "v", name="mid").withColumn("mid", F.col("mid") + top + 1)
    ends = e.join(at.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u").join(at.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
    mids = ends.select(F.col("mid").alias("node_id"), ((F.col("ux") + F.col("vx")) / 2).alias("x"), ((F.col("uy") + F.col("vy")) / 2).alias("y"))
    return Graph(at.union(mids), normalise(e.select("u", F.col("mid").alias("v")).union(e.select("v", "mid"))))


def face_refine(g: Graph) -> Graph:
    """A node in the middle of every bounded face, joined to its corners."""
    at = g.nodes.select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    top = at.agg(F.max("node_id")).first()[0] or 0
    f = faces(g)
    inner = dense_ids(bounded_faces(g, f).select("face", "cx", "cy"), "face", name="node_id").withColumn("node_id", F.col("node_id") + top + 1)
    spokes = f.join(inner, "face").select(F.col("src").alias("u"), F.col("node_id").alias("v"))
    return Graph(at.union(inner.select("node_id", "cx", "cy")), normalise(g.edges.select("u", "v").union(spokes)))


def barycentric(g: Graph) -> Graph:
    return face_refine(edge_refine(g))


def boundary_ends(cut: DataFrame) -> DataFrame:
    """Points that are an end of one only of the cut edges(ux, uy, vx, vy) when each is turned by 90 degrees about its middle."""
    mx, my = (F.col("ux") + F.col("vx")) / 2, (F.col("uy") + F.col("vy")) / 2
    hx, hy = (F.col("vy") - F.col("uy")) / 2, (F.col("vx") - F.col("ux")) / 2
    ends = cut.select(F.explode(F.array(F.struct((mx - hx).alias("x"), (my + hy).alias("y")), F.struct((mx + hx).alias("x"), (my - hy).alias("y")))).alias("p"))
    return ends.groupBy("p.x", "p.y").agg(F.count("*").alias("n")).where("n = 1").select("x", "y")
