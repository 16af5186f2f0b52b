"""Queries on generated graphs, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import random_int_sql, random_unit
from ..operators import connect, enumerate, generators, planar, sampling, statistics
from ..operators.graph import Graph, dense_ids
from .registry import Registry

R = Registry()


def grid_sql(w: int, h: int) -> str:
    return f"""nodes AS (SELECT i AS node_id, CAST(i % {w} AS INTEGER) AS x, CAST(i // {w} AS INTEGER) AS y FROM range({w * h}) t(i)),
edges AS (SELECT node_id AS u, node_id + 1 AS v FROM nodes WHERE x < {w - 1} UNION ALL SELECT node_id, node_id + {w} FROM nodes WHERE y < {h - 1}),
numbered AS (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS edge_id FROM edges)"""


def numbered(g: Graph) -> DataFrame:
    """edges with edge_id from 0 by (u, v)."""
    return dense_ids(g.edges.select("u", "v"), "u", "v", name="edge_id")


def unit_sql(seed: str, step: str, k: str) -> str:
    return f"(CAST({random_int_sql(seed, step, k)} AS DOUBLE) / 2147483647.0)"


@R.add("torus_edges", "SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT i AS a, unnest([i // 6 * 6 + (i % 6 + 1) % 6, (i // 6 + 1) % 6 * 6 + i % 6]) AS b FROM range(36) t(i))")
def torus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.torus(spark, 6).edges.select("u", "v")


@R.add("lattice_3d_edges", "SELECT i AS u, unnest(list_filter([CASE WHEN i % 3 < 2 THEN i + 1 END, CASE WHEN i // 3 % 3 < 2 THEN i + 3 END, CASE WHEN i // 9 < 1 THEN i + 9 END], lambda q: q IS NOT NULL)) AS v FROM range(18) t(i)")
def lattice_3d_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.lattice(spark, 3, 3, 2).edges.select("u", "v")


_DISC = "SELECT CAST(a.i - 8 AS INTEGER) AS x, CAST(b.i - 8 AS INTEGER) AS y FROM range(17) a(i), range(17) b(i) WHERE sqrt((a.i - 8) ** 2 + (b.i - 8) ** 2) < 8.5"


@R.add("disc_nodes", _DISC)
def disc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.disc(spark, 8).nodes.select("x", "y")


@R.add("disc_faces", f"WITH d AS ({_DISC}) SELECT a.x, a.y, a.x + 0.5::DOUBLE AS cx, a.y + 0.5::DOUBLE AS cy FROM d a JOIN d b ON b.x = a.x + 1 AND b.y = a.y JOIN d c ON c.x = a.x AND c.y = a.y + 1 JOIN d e ON e.x = a.x + 1 AND e.y = a.y + 1")
def disc_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.disc_faces(spark, 8)


@R.add("disc_degrees", f"WITH d AS ({_DISC}) SELECT degree, count(*) AS n FROM (SELECT a.x, a.y, (SELECT count(*) FROM d b WHERE abs(a.x - b.x) + abs(a.y - b.y) = 1) AS degree FROM d a) GROUP BY degree")
def disc_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.disc(spark, 8).degree().groupBy("degree").agg(F.count("*").alias("n"))


_MASKS = {
    "biased": (12, "(x BETWEEN 6 AND 10 OR x BETWEEN 0 AND 4) AND y <= 10", "false"),
    "debiased": (12, "x % 2 = 0 AND (x BETWEEN 6 AND 10 OR x BETWEEN 0 AND 4) AND y <= 10", "x % 2 = 1 AND (x BETWEEN 6 AND 10 OR x BETWEEN 0 AND 4) AND y <= 10"),
    "biased_1": (8, "(y BETWEEN 4 AND 6 OR y BETWEEN 0 AND 2) AND x <= 6", "false"),
    "debiased_1": (8, "x % 2 = 0 AND (y BETWEEN 4 AND 6 OR y BETWEEN 0 AND 2) AND x <= 6", "x % 2 = 1 AND (y BETWEEN 4 AND 6 OR y BETWEEN 0 AND 2) AND x <= 6"),
    "four_squares": (12, "(x BETWEEN 6 AND 10 OR x BETWEEN 0 AND 4) AND (y BETWEEN 6 AND 10 OR y BETWEEN 0 AND 4)", "false"),
    "one_line": (12, "x BETWEEN 4 AND 6 AND y BETWEEN 5 AND 7", "false"),
    "anti_four_squares": (12, "x BETWEEN 4 AND 6 AND y <= 9 OR y BETWEEN 4 AND 6 AND x <= 9", "false"),
    "center_square": (12, "x BETWEEN 4 AND 6 AND y BETWEEN 4 AND 6", "false"),
    "meta_mander": (12, "NOT (x > 3 AND x <= 5 OR x > 7 AND x <= 9) AND NOT (x > 5 AND x <= 7 AND y > 4 AND y <= 6) AND y < 10 AND x < 11", "false"),
}


def _masks_sql() -> str:
    parts = []
    for kind, (n, up, down) in _MASKS.items():
        g = f"(SELECT i, i % {n} AS x, i // {n} AS y FROM range({n * n}) t(i))"
        parts.append(
            f"SELECT '{kind}' AS kind, i AS u, i + {n + 1} AS v FROM {g} WHERE x < {n - 1} AND y < {n - 1} AND ({up}) UNION SELECT '{kind}', least(i, i - {n - 1}), greatest(i, i - {n - 1}) FROM {g} WHERE x < {n - 1} AND y > 0 AND ({down})"
        )
    return " UNION ALL ".join(f"({p})" for p in parts)


@R.add("diagonal_masks", _masks_sql())
def diagonal_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in _MASKS:
        n, _, _ = generators.diagonal_mask(kind, 2)
        g = generators.diagonals(spark, kind, 2)
        own = g.edges.where(f"NOT (v - u = 1 AND u % {n} < {n - 1} OR v - u = {n})").select(F.lit(kind).alias("kind"), "u", "v")
        out = own if out is None else out.union(own)
    return out


_PIZZA = "(SELECT *, x / 8.0::DOUBLE - 2 AS px, y / 8.0::DOUBLE - 2 AS py FROM (SELECT CAST(i % 32 AS INTEGER) AS x, CAST(i // 32 AS INTEGER) AS y FROM range(1024) t(i)))"
_PIZZA = f"(SELECT x, y, px * px + py * py AS q, atan2(py, px) / pi() AS a FROM {_PIZZA} WHERE px * px + py * py < 1)"
_MOD = "(a - 0.5::DOUBLE * floor(a / 0.5::DOUBLE))"
_PATTERNS = {
    "annulus": ("sqrt(q) > 1/3.0::DOUBLE AND sqrt(q) < 2/3.0::DOUBLE", "1"),
    "sectors": ("(a >= -0.6::DOUBLE AND a < -0.3::DOUBLE OR a >= 0 AND a < 0.3::DOUBLE OR a >= 0.6::DOUBLE AND a < 0.9::DOUBLE) AND sqrt(q) < 0.9::DOUBLE", "1"),
    "signed": ("sqrt(q) > 1/3.0::DOUBLE AND sqrt(q) < 2/3.0::DOUBLE", "CASE WHEN a > 0 THEN 1 ELSE -1 END"),
    "windows": (f"({_MOD} > 0.0625 AND {_MOD} < 0.185::DOUBLE OR {_MOD} > 0.3125 AND {_MOD} < 0.44::DOUBLE) AND sqrt(q) > 1/3.0::DOUBLE AND sqrt(q) < 0.8::DOUBLE", "1"),
    "wide_windows": (f"({_MOD} > 0.03::DOUBLE AND {_MOD} < 0.22::DOUBLE OR {_MOD} > 0.28::DOUBLE AND {_MOD} < 0.47::DOUBLE) AND sqrt(q) > 0.3::DOUBLE AND sqrt(q) < 0.8::DOUBLE", "1"),
}


@R.add("disc_patterns", " UNION ALL ".join(f"SELECT '{k}' AS kind, x, y, CAST({dx} AS INTEGER) AS dx FROM {_PIZZA} WHERE {c}" for k, (c, dx) in _PATTERNS.items()))
def disc_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in _PATTERNS:
        own = generators.disc_pattern(spark, 8, kind).select(F.lit(kind).alias("kind"), "x", "y", "dx")
        out = own if out is None else out.union(own)
    return out


_LAYERED = "(SELECT CAST(l.i AS INTEGER) AS layer, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j FROM range(8) l(i), range(6) a(i), range(6) b(i))"


@R.add("layered_digraphs", f"SELECT 'complete' AS kind, * FROM {_LAYERED} UNION ALL SELECT 'disjoint', * FROM {_LAYERED} WHERE layer = 0 AND i = 0 OR layer BETWEEN 1 AND 6 AND i = j OR layer = 7 AND j = 0 UNION ALL SELECT 'diamonds', * FROM {_LAYERED} WHERE layer = 0 AND i = 0 AND j IN (1, 4) OR layer = 7 AND j = 0 AND i IN (1, 4) OR layer IN (1, 3, 5) AND i IN (1, 4) AND j IN (i - 1, i + 1) OR layer IN (2, 4, 6) AND j IN (1, 4) AND i IN (j - 1, j + 1)")
def layered_digraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [generators.layered_edges(spark, k, 6, 3).select(F.lit(k).alias("kind"), "layer", "i", "j") for k in ("complete", "disjoint", "diamonds")]
    return parts[0].union(parts[1]).union(parts[2])


@R.add("layered_bernoulli", f"SELECT layer, i, j FROM {_LAYERED} WHERE {unit_sql('3', 'layer', 'i * 6 + j')} < 0.4")
def layered_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.layered_edges(spark, "bernoulli", 6, 3, 0.4, 3)


@R.add("layered_random", f"SELECT DISTINCT layer, i, CAST(floor({unit_sql('4', 'layer * 6 + i', 'k.k')} * 6) AS INTEGER) AS j FROM (SELECT DISTINCT layer, i FROM {_LAYERED}), range(1, 4) k(k)")
def layered_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.layered_edges(spark, "random", 6, 3, 0.5, 4)


@R.add("random_diagonals", f"WITH g AS (SELECT i, i % 12 AS x, i // 12 AS y FROM range(144) t(i)) SELECT i AS u, i + 13 AS v FROM g WHERE x < 11 AND y < 11 AND ({unit_sql('5', 'i', '0')} < 0.2 OR {unit_sql('5', 'i', '1')} < (0.9 - 0.2) / (1 - 0.2) AND x % 4 < 2)")
def random_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.random_diagonals(spark, 2, F.col("x") % 4 < 2, seed=5).edges.where("v - u = 13").select("u", "v")


@R.add("doubled_tree_levels", """
WITH RECURSIVE t AS (SELECT 0 AS level, 0 AS k UNION ALL SELECT level + 1, k * 2 + c FROM t, (VALUES (0), (1)) b(c) WHERE level < 3)
SELECT CAST(level AS INTEGER) AS level, CAST(half AS INTEGER) AS half, count(*) AS n, CAST(sum(degree) AS BIGINT) AS degrees FROM (
  SELECT level, CASE WHEN level = 3 THEN 0 ELSE 1 END AS half, CASE WHEN level = 0 THEN 2 WHEN level = 3 THEN 2 ELSE 3 END AS degree FROM t
  UNION ALL SELECT level, -1, CASE WHEN level = 0 THEN 2 ELSE 3 END FROM t WHERE level < 3) GROUP BY ALL""")
def doubled_tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generators.doubled_tree(spark, 2, 3)
    return g.nodes.join(g.degree(), "node_id").groupBy("level", "half").agg(F.count("*").alias("n"), F.sum("degree").cast("long").alias("degrees"))


@R.add("gadget_degrees", "SELECT CAST(l.i AS INTEGER) AS level, CASE WHEN l.i = 0 THEN 5 WHEN l.i = 3 THEN 4 ELSE 6 END::BIGINT AS degree, 3::BIGINT AS n FROM range(4) l(i) UNION ALL SELECT -1, 3, 1")
def gadget_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generators.gadget(spark, 3, clasp=True)
    return g.nodes.join(g.degree(), "node_id").groupBy("level", "degree").agg(F.count("*").alias("n"))


@R.add("replaced_edges", f"WITH {grid_sql(3, 3)}, p(a, b) AS (VALUES (-1, 0), (0, -2), (-1, 1), (1, -2)) SELECT CASE WHEN a = -1 THEN 'n' || u ELSE 'e_' || u || '_' || v || '_' || a END AS u, CASE WHEN b = -2 THEN 'n' || v ELSE 'e_' || u || '_' || v || '_' || b END AS v FROM edges, p")
def replaced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    diamond = spark.sql("SELECT * FROM VALUES (-1, 0), (0, -2), (-1, 1), (1, -2) AS t(a, b)")
    return generators.replace_edges(generators.lattice(spark, 3, 3), 2, diamond)


_ROTATION = f"""WITH {grid_sql(4, 3)}, half AS (SELECT u AS s, v AS d FROM edges UNION ALL SELECT v, u FROM edges),
a AS (SELECT s, d, atan2(q.x - p.x, q.y - p.y) AS angle FROM half JOIN nodes p ON p.node_id = s JOIN nodes q ON q.node_id = d),
r AS (SELECT s AS src, d AS dst, coalesce(lead(d) OVER w, first_value(d) OVER (PARTITION BY s ORDER BY angle)) AS next FROM a WINDOW w AS (PARTITION BY s ORDER BY angle))"""


@R.add("grid_rotation", f"{_ROTATION} SELECT src, dst, next FROM r")
def grid_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planar.rotation(generators.lattice(spark, 4, 3))


_FACES = _ROTATION.replace("WITH ", "WITH RECURSIVE ", 1) + """, step AS (SELECT dst AS a, src AS b, src AS c, next AS d FROM r),
o AS (SELECT a * 100 + b AS h, a, b, c, d, 0 AS k FROM step UNION ALL SELECT o.h, s.a, s.b, s.c, s.d, k + 1 FROM o JOIN step s ON s.a = o.c AND s.b = o.d WHERE k < 40),
f AS (SELECT h, min(a * 100 + b) AS face FROM o GROUP BY h)"""


@R.add("grid_faces", f"{_FACES} SELECT CAST(length AS BIGINT) AS length, count(*) AS n FROM (SELECT face, count(*) AS length FROM f GROUP BY face) GROUP BY length")
def grid_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planar.faces(generators.lattice(spark, 4, 3)).groupBy("face").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("n"))


@R.add("grid_bounded_faces", "SELECT CAST(a.i + 0.5 AS DOUBLE) AS cx, CAST(b.i + 0.5 AS DOUBLE) AS cy, 4::BIGINT AS length FROM range(3) a(i), range(2) b(i)")
def grid_bounded_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planar.bounded_faces(generators.lattice(spark, 4, 3)).select("cx", "cy", "length")


@R.add("grid_dual", f"WITH {grid_sql(4, 3)} SELECT u, v FROM edges JOIN nodes p ON p.node_id = u WHERE v = u + 1 AND p.y = 1 OR v = u + 4 AND p.x IN (1, 2)")
def grid_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planar.dual(generators.lattice(spark, 4, 3)).select("u", "v")


@R.add("cut_to_dual", f"WITH {grid_sql(4, 3)} SELECT u, v FROM edges JOIN nodes p ON p.node_id = u WHERE v = u + 4 AND p.y = 0 AND p.x IN (1, 2)")
def cut_to_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generators.lattice(spark, 4, 3)
    return planar.cut_to_dual(planar.dual(g), g.edges.where("v = u + 4 AND u < 4").select(F.col("v").alias("u"), F.col("u").alias("v"))).select("u", "v")


@R.add("refinement_counts", "SELECT * FROM (SELECT 12 AS v, 17 AS e, 6 AS f), LATERAL (SELECT 'edge' AS kind, CAST(v + e AS BIGINT) AS n_nodes, CAST(2 * e AS BIGINT) AS n_edges UNION ALL SELECT 'face', v + f, e + 4 * f UNION ALL SELECT 'barycentric', v + e + f, 2 * e + 8 * f)".replace("SELECT * FROM", "SELECT kind, n_nodes, n_edges FROM"))
def refinement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, refine in (("edge", planar.edge_refine), ("face", planar.face_refine), ("barycentric", planar.barycentric)):
        g = refine(generators.lattice(spark, 4, 3))
        own = g.nodes.agg(F.count("*").alias("n_nodes")).join(g.edges.agg(F.count("*").alias("n_edges"))).select(F.lit(kind).alias("kind"), "n_nodes", "n_edges")
        out = own if out is None else out.union(own)
    return out


def _plans(spark: SparkSession, n: int = 6) -> tuple[Graph, DataFrame]:
    g = generators.lattice(spark, n, n)
    rules = {0: f"y >= {n // 2}", 1: "x % 2 = 1", 2: f"(x < {n // 2}) = (y < {n // 2})", 3: f"y >= {n // 2} OR x = 0"}
    plans = None
    for k, rule in rules.items():
        own = g.nodes.select(F.lit(k).cast("long").alias("plan_id"), "node_id", F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END").alias("district"))
        plans = own if plans is None else plans.union(own)
    return g, plans


_PLANS = f"{grid_sql(6, 6)}, plan AS (SELECT k AS plan_id, node_id, x, y, CAST(CASE k WHEN 0 THEN y >= 3 WHEN 1 THEN x % 2 = 1 WHEN 2 THEN (x < 3) = (y < 3) ELSE y >= 3 OR x = 0 END AS INTEGER) AS district FROM nodes, range(4) p(k)), cut AS (SELECT a.plan_id, e.u, e.v, a.district AS du, b.district AS dv, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM edges e JOIN plan a ON a.node_id = e.u JOIN plan b ON b.node_id = e.v AND b.plan_id = a.plan_id WHERE a.district <> b.district)"


@R.add("plan_cut_sizes", f"WITH {_PLANS} SELECT plan_id, count(*) AS n_cut FROM cut GROUP BY plan_id")
def plan_cut_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, plans = _plans(spark)
    return statistics.cut_size(plans, g.edges)


@R.add("plan_slopes", f"WITH {_PLANS} SELECT plan_id, CAST(sum(CASE WHEN du < dv THEN vx - ux ELSE ux - vx END) AS BIGINT) AS dx, CAST(sum(CASE WHEN du < dv THEN vy - uy ELSE uy - vy END) AS BIGINT) AS dy FROM cut GROUP BY plan_id")
def plan_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, plans = _plans(spark)
    return statistics.slope(statistics.cut_edges(plans, g.edges), g.nodes)


_SEATS = "SELECT plan_id, district, CAST(sum(CASE WHEN y >= 0.4 * 6 THEN 1 ELSE -1 END) AS BIGINT) AS margin, CAST(sign(sum(CASE WHEN y >= 0.4 * 6 THEN 1 ELSE -1 END)) AS INTEGER) AS seat FROM plan GROUP BY plan_id, district"


def _votes(g: Graph) -> DataFrame:
    return g.nodes.select("node_id", F.expr("CASE WHEN y >= 0.4 * 6 THEN 1 ELSE 0 END").alias("vote"))


@R.add("plan_seats", f"WITH {_PLANS} {_SEATS}")
def plan_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, plans = _plans(spark)
    return statistics.seats(plans, _votes(g))


@R.add("plan_fair", f"WITH {_PLANS} SELECT plan_id, CAST(sum(seat) = 0 AS INTEGER) AS fair FROM ({_SEATS}) GROUP BY plan_id")
def plan_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, plans = _plans(spark)
    return statistics.fair(statistics.seats(plans, _votes(g)))


@R.add("plan_boundary_nodes", f"WITH {_PLANS} SELECT plan_id, u AS node_id, dv AS other FROM cut UNION SELECT plan_id, v, du FROM cut")
def plan_boundary_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, plans = _plans(spark)
    return statistics.boundary_nodes(statistics.cut_edges(plans, g.edges))


@R.add("plan_boundary_ends", "SELECT * FROM (VALUES (-0.5::DOUBLE, 2.5::DOUBLE), (5.5::DOUBLE, 2.5::DOUBLE)) t(x, y)")
def plan_boundary_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, plans = _plans(spark)
    cut = statistics.cut_edges(plans.where("plan_id = 0"), g.edges)
    a, b = (g.nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k in "uv")
    return planar.boundary_ends(cut.join(a, "u").join(b, "v"))


@R.add("plan_block_components", f"WITH RECURSIVE {_PLANS}, reach AS (SELECT plan_id, node_id, node_id AS other FROM plan UNION SELECT r.plan_id, r.node_id, b.node_id FROM reach r JOIN plan a ON a.plan_id = r.plan_id AND a.node_id = r.other JOIN plan b ON b.plan_id = r.plan_id AND b.district = a.district AND abs(a.x - b.x) + abs(a.y - b.y) = 1) SELECT p.plan_id, p.district, count(DISTINCT c) AS n_components FROM plan p JOIN (SELECT plan_id, node_id, min(other) AS c FROM reach GROUP BY ALL) USING (plan_id, node_id) GROUP BY ALL")
def plan_block_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, plans = _plans(spark)
    return connect.block_components(plans, g.edges)


_DRAWN = f"{grid_sql(4, 4)}, kept AS (SELECT * FROM numbered WHERE {unit_sql('6', '0', 'edge_id')} < 0.5), reach AS (SELECT node_id AS a, node_id AS b FROM nodes UNION SELECT r.a, CASE WHEN k.u = r.b THEN k.v ELSE k.u END FROM reach r JOIN kept k ON r.b IN (k.u, k.v)), comp AS (SELECT a AS node_id, min(b) AS comp FROM reach GROUP BY a)"


def _drawn(spark: SparkSession) -> tuple[Graph, DataFrame, DataFrame]:
    g = generators.lattice(spark, 4, 4)
    e = numbered(g)
    return g, e, e.where(random_unit(6, 0, F.col("edge_id")) < 0.5)


@R.add("drawn_components", f"WITH RECURSIVE {_DRAWN} SELECT node_id, comp FROM comp")
def drawn_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, kept = _drawn(spark)
    return connect.components(g.nodes, kept)


@R.add("drawn_closure", f"WITH RECURSIVE {_DRAWN} SELECT u, v FROM edges JOIN comp a ON a.node_id = u JOIN comp b ON b.node_id = v WHERE a.comp = b.comp")
def drawn_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, e, kept = _drawn(spark)
    return connect.closure(g.nodes, e, kept)


@R.add("drawn_rank", f"WITH RECURSIVE {_DRAWN} SELECT 16 - count(DISTINCT comp) AS rank, (SELECT count(*) FROM kept) AS n_edges, 16 - count(DISTINCT comp) = (SELECT count(*) FROM kept) AS forest FROM comp")
def drawn_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, kept = _drawn(spark)
    return connect.rank(g.nodes, kept)


@R.add("separating_pairs", f"WITH RECURSIVE {grid_sql(4, 2)}, pr AS (SELECT p.node_id AS a, q.node_id AS b FROM nodes p, nodes q WHERE p.node_id < q.node_id), reach AS (SELECT a, b, (SELECT min(node_id) FROM nodes WHERE node_id NOT IN (a, b)) AS n FROM pr UNION SELECT r.a, r.b, CASE WHEN u = n THEN v ELSE u END FROM reach r JOIN edges ON n IN (u, v) WHERE (CASE WHEN u = n THEN v ELSE u END) NOT IN (r.a, r.b)) SELECT a, b FROM reach GROUP BY a, b HAVING count(*) < 6")
def separating_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generators.lattice(spark, 4, 2)
    return connect.separating_pairs(g.nodes, g.edges)


@R.add("face_cycles", "SELECT CAST(i AS BIGINT) AS key, i < 6 AS is_cycle FROM range(7) t(i)")
def face_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generators.lattice(spark, 4, 3)
    corner = g.nodes.where("x < 3 AND y < 2").select((F.col("x") + 3 * F.col("y")).cast("long").alias("key"), F.expr("array(struct(node_id as u, node_id + 1 as v), struct(node_id as u, node_id + 4 as v), struct(node_id + 1 as u, node_id + 5 as v), struct(node_id + 4 as u, node_id + 5 as v))").alias("e"))
    rows = corner.select("key", F.explode("e").alias("e")).select("key", "e.u", "e.v").union(spark.sql("SELECT 6L, id, id + 1 FROM range(3)"))
    return connect.simple_cycle(rows)


_WALK = f"SELECT w AS path_id, pos, CAST(sum(dx) OVER q AS BIGINT) AS x, CAST(sum(dy) OVER q AS BIGINT) AS y FROM (SELECT w, pos, CASE WHEN u < 0.7 THEN 1 ELSE 0 END AS dx, CASE WHEN u < 0.7 THEN 0 WHEN u < 0.9 THEN 1 ELSE -1 END AS dy FROM (SELECT w, pos, {unit_sql('8', 'w', 'pos')} AS u FROM range(20) a(w), range(25) b(pos))) WINDOW q AS (PARTITION BY w ORDER BY pos)"


def _paths(spark: SparkSession) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("path_id").orderBy("pos")
    rows = spark.range(500).select(F.expr("id div 25").alias("path_id"), F.expr("id % 25").alias("pos")).withColumn("u", random_unit(8, F.col("path_id"), F.col("pos")))
    return rows.select("path_id", "pos", F.sum(F.when(F.col("u") < 0.7, 1).otherwise(0)).over(w).alias("x"), F.sum(F.when(F.col("u") < 0.7, 0).when(F.col("u") < 0.9, 1).otherwise(-1)).over(w).alias("y"))


@R.add("path_self_avoiding", f"WITH p AS ({_WALK}) SELECT path_id, count(*) = count(DISTINCT (x, y)) AS self_avoiding, (SELECT count(*) FROM p a, p b WHERE a.path_id = p.path_id AND b.path_id = p.path_id AND a.pos + 1 < b.pos AND abs(a.x - b.x) + abs(a.y - b.y) <= 1) AS n_double_back FROM p GROUP BY path_id")
def path_self_avoiding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connect.self_avoiding(_paths(spark))


_FLATS = """, masks AS (SELECT m AS mask FROM range(CAST(pow(2, (SELECT count(*) FROM edges)) AS BIGINT)) t(m)), kept AS (SELECT mask, u, v FROM masks, numbered WHERE (mask >> edge_id) & 1 = 1),
reach AS (SELECT mask, node_id AS a, node_id AS b FROM masks, nodes UNION SELECT r.mask, r.a, CASE WHEN k.u = r.b THEN k.v ELSE k.u END FROM reach r JOIN kept k ON k.mask = r.mask AND r.b IN (k.u, k.v)),
comp AS (SELECT mask, a AS node_id, min(b) AS comp FROM reach GROUP BY ALL),
bad AS (SELECT DISTINCT m.mask FROM masks m, numbered n JOIN comp p ON p.mask = m.mask AND p.node_id = n.u JOIN comp q ON q.mask = m.mask AND q.node_id = n.v WHERE (m.mask >> n.edge_id) & 1 = 0 AND p.comp = q.comp),
flat AS (SELECT mask, count(DISTINCT comp) AS n_blocks FROM comp WHERE mask NOT IN (SELECT mask FROM bad) GROUP BY mask)"""


@R.add("flats_count_3x3", f"WITH RECURSIVE {grid_sql(3, 3)}{_FLATS} SELECT CAST(count(*) AS DECIMAL(38,0)) AS n_partitions FROM flat")
def flats_count_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enumerate.connected_partitions(spark, 3, 3)


@R.add("flats_by_blocks_3x2", f"WITH RECURSIVE {grid_sql(3, 2)}{_FLATS} SELECT n_blocks, count(*) AS n FROM flat GROUP BY n_blocks")
def flats_by_blocks_3x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generators.lattice(spark, 3, 2)
    return enumerate.flats(g.nodes, numbered(g), 7).groupBy("n_blocks").agg(F.count("*").alias("n"))


@R.add("flats_enumerate_2x2", f"WITH RECURSIVE {grid_sql(2, 2)}{_FLATS} SELECT mask, n_blocks FROM flat")
def flats_enumerate_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generators.lattice(spark, 2, 2)
    return enumerate.flats(g.nodes, numbered(g), 4)


@R.add("simple_paths_4x4", f"WITH RECURSIVE {grid_sql(4, 4)}, half AS (SELECT u AS a, v AS b FROM edges UNION ALL SELECT v, u FROM edges), p AS (SELECT 0::BIGINT AS spot, [0::BIGINT] AS seen, 0 AS length UNION ALL SELECT b, list_append(seen, b), length + 1 FROM p JOIN half ON a = spot WHERE spot <> 15 AND NOT list_contains(seen, b)) SELECT length, CAST(count(*) AS DECIMAL(38,0)) AS n_paths FROM p WHERE spot = 15 GROUP BY length")
def simple_paths_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enumerate.simple_paths(generators.lattice(spark, 4, 4).edges, 0, 15, 15)


_LDAG = f"""WITH RECURSIVE e AS (SELECT * FROM {_LAYERED} WHERE layer < 4 AND i < 4 AND j < 4 AND (layer > 0 OR i = 0)), w AS (SELECT CAST(i // 4 AS INTEGER) AS layer, CAST(i % 4 AS INTEGER) AS i, i * 7 % 5 AS weight FROM range(20) t(i)),
p AS (SELECT 0 AS layer, 0 AS i, 0::BIGINT AS weight UNION ALL SELECT p.layer + 1, e.j, p.weight + w.weight FROM p JOIN e ON e.layer = p.layer AND e.i = p.i JOIN w ON w.layer = p.layer + 1 AND w.i = e.j),
d AS (SELECT i, weight, CAST(count(*) AS DECIMAL(38,0)) AS n_paths FROM p WHERE layer = 4 GROUP BY ALL)"""


def _ldag(spark: SparkSession) -> DataFrame:
    weights = spark.range(20).select(F.expr("cast(id div 4 as int)").alias("layer"), F.expr("cast(id % 4 as int)").alias("i"), F.expr("id * 7 % 5").alias("weight"))
    return enumerate.layered_weights(generators.layered_edges(spark, "complete", 4, 2), weights, 4)


@R.add("ldag_weight_distribution", f"{_LDAG} SELECT i, weight, n_paths FROM d")
def ldag_weight_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ldag(spark)


@R.add("ldag_unique_least", f"{_LDAG} SELECT i, least, n_least, CASE WHEN n_least > 1 THEN 2 ELSE 1 END AS flag FROM (SELECT i, min(weight) AS least, arg_min(n_paths, weight) AS n_least FROM d GROUP BY i)")
def ldag_unique_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enumerate.unique_least(_ldag(spark))


@R.add("partial_evaluations", """
WITH RECURSIVE poly(poly_id, term_mask) AS (VALUES (0, 7::BIGINT), (1, 3), (1, 6), (2, 11), (2, 14)), s AS (SELECT CAST(d AS INTEGER) AS depth, o AS ones FROM range(5) a(d), range(16) b(o) WHERE o < (1 << d)),
t AS (SELECT poly_id, depth, ones, term_mask >> depth AS rest, count(*) AS n FROM poly, s WHERE list_bool_and([((term_mask >> k) & 1) = 0 OR k >= depth OR ((ones >> k) & 1) = 1 FOR k IN range(4)]) GROUP BY ALL),
u AS (SELECT poly_id, depth, ones, string_agg(rest, ',' ORDER BY rest) AS terms FROM t WHERE n % 2 = 1 GROUP BY ALL)
SELECT p.poly_id, s.depth, count(DISTINCT coalesce(terms, '')) AS n_distinct FROM (SELECT DISTINCT poly_id FROM poly) p CROSS JOIN s LEFT JOIN u ON u.poly_id = p.poly_id AND u.depth = s.depth AND u.ones = s.ones GROUP BY ALL""")
def partial_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    poly = spark.sql("SELECT * FROM VALUES (0, 7L), (1, 3L), (1, 6L), (2, 11L), (2, 14L) AS t(poly_id, term_mask)")
    return enumerate.partial_evaluations(poly, 4)


@R.add("metagraph_degrees", "WITH m AS (SELECT i AS mask FROM range(64) t(i) WHERE bit_count(i) BETWEEN 2 AND 3) SELECT a.mask, count(*) AS degree FROM m a JOIN m b ON bit_count(xor(a.mask, b.mask)) = 1 GROUP BY a.mask")
def metagraph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = enumerate.subsets(spark, 6).where("size BETWEEN 2 AND 3").select("mask")
    return enumerate.metagraph(masks).groupBy(F.col("a").alias("mask")).agg(F.count("*").alias("degree"))


@R.add("primes_upto", "SELECT i AS p FROM range(2, 2000) t(i) WHERE NOT EXISTS (SELECT 1 FROM range(2, 45) d(d) WHERE d < i AND i % d = 0)")
def primes_upto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enumerate.primes(spark, 2000)


@R.add("fibonacci", "WITH RECURSIVE f(k, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT k + 1, b, a + b FROM f WHERE b < 1000000000000) SELECT k, a AS f FROM f")
def fibonacci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enumerate.fibonacci(spark, 1_000_000_000_000)


@R.add("equal_sums", "WITH m AS (SELECT i AS code, i // 8 AS x, i % 8 AS y FROM range(64) t(i) WHERE i // 8 <= i % 8), s AS (SELECT code, k, x * k % 5 + y * k % 5 AS s FROM m, range(1, 5) r(k)) SELECT a.code AS a, b.code AS b FROM s a JOIN s b USING (k) WHERE a.code < b.code GROUP BY ALL HAVING bool_and(a.s = b.s)")
def equal_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enumerate.equal_sums(spark, 5, 8)


_SAMPLED = f"{grid_sql(3, 3)}, drawn AS (SELECT s AS sample_id, u, v, {unit_sql('9', 's', 'edge_id')} < 0.5 AS kept FROM range(60) t(s), numbered), reach AS (SELECT s AS sample_id, node_id AS a, node_id AS b FROM range(60) t(s), nodes UNION SELECT r.sample_id, r.a, CASE WHEN d.u = r.b THEN d.v ELSE d.u END FROM reach r JOIN drawn d ON d.sample_id = r.sample_id AND d.kept AND r.b IN (d.u, d.v)), comp AS (SELECT sample_id, a AS node_id, min(b) AS comp FROM reach GROUP BY ALL)"


def _sampled(spark: SparkSession) -> tuple[Graph, DataFrame]:
    g = generators.lattice(spark, 3, 3)
    return g, sampling.edge_subset_samples(spark, numbered(g), 60, 9)


@R.add("rejection_samples", f"WITH RECURSIVE {_SAMPLED} SELECT c.sample_id, count(DISTINCT comp) AS n_blocks, NOT EXISTS (SELECT 1 FROM drawn d JOIN comp p ON p.sample_id = d.sample_id AND p.node_id = d.u JOIN comp q ON q.sample_id = d.sample_id AND q.node_id = d.v WHERE d.sample_id = c.sample_id AND NOT d.kept AND p.comp = q.comp) AS accepted FROM comp c GROUP BY c.sample_id")
def rejection_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, drawn = _sampled(spark)
    return sampling.accepted_flats(g.nodes, drawn)


@R.add("percolation_largest", f"WITH RECURSIVE {_SAMPLED} SELECT sample_id, max(k) AS size FROM (SELECT sample_id, comp, count(*) AS k FROM comp GROUP BY ALL) GROUP BY sample_id")
def percolation_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, drawn = _sampled(spark)
    labels = connect.components(drawn.select("sample_id").distinct().crossJoin(g.nodes.select("node_id")), drawn.where("kept").select("sample_id", "u", "v"), ("sample_id",))
    return sampling.largest_block(labels)


@R.add("random_spanning_trees", f"WITH RECURSIVE {grid_sql(3, 3)}, w AS (SELECT s AS sample_id, u, v, {unit_sql('10', 's', 'edge_id')} AS weight FROM range(8) t(s), numbered), reach AS (SELECT sample_id, u AS eu, v AS ev, weight, u AS n FROM w UNION SELECT r.sample_id, r.eu, r.ev, r.weight, CASE WHEN w.u = r.n THEN w.v ELSE w.u END FROM reach r JOIN w ON w.sample_id = r.sample_id AND w.weight < r.weight AND r.n IN (w.u, w.v)) SELECT sample_id, u, v FROM w WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.sample_id = w.sample_id AND r.eu = w.u AND r.ev = w.v AND r.n = w.v)")
def random_spanning_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generators.lattice(spark, 3, 3)
    return sampling.random_forests(spark, g.nodes, numbered(g), 8, 10).select("sample_id", "u", "v")


@R.add("wilson_trees", "SELECT s AS sample_id, 15::BIGINT AS n_edges, 16::BIGINT AS n_nodes FROM range(40) t(s)")
def wilson_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = sampling.wilson_trees(spark, generators.lattice(spark, 4, 4).edges, 40, 2)
    ends = trees.select("sample_id", F.explode(F.array("u", "v")).alias("n")).groupBy("sample_id").agg(F.countDistinct("n").alias("n_nodes"))
    return trees.distinct().groupBy("sample_id").agg(F.count("*").alias("n_edges")).join(ends, "sample_id")


@R.add("hash_isolation", "WITH n AS (SELECT CAST(i // 4 AS INTEGER) AS layer, CAST(i % 4 AS INTEGER) AS i, i AS label FROM range(20) t(i)) SELECT layer, i, CASE WHEN layer % 2 = 1 THEN label * 5 % 23 ELSE 0 END + CASE WHEN layer % 4 = 2 THEN label * 11 % 23 ELSE 0 END AS weight FROM n")
def hash_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(20).select(F.expr("cast(id div 4 as int)").alias("layer"), F.expr("cast(id % 4 as int)").alias("i"), F.col("id").alias("label"))
    return sampling.hash_weights(nodes, 23, [5, 11]).select("layer", "i", "weight")


@R.add("min_unique_sets", "WITH f AS (SELECT f, s, i FROM range(6) a(f), range(1, 32) b(s), range(5) c(i) WHERE (s >> i) & 1 = 1 AND bit_count(s) = 2), w AS (SELECT f AS family_id, s, sum((i + f) * 3 % 7) AS w FROM f GROUP BY ALL), m AS (SELECT family_id, min(w) AS least FROM w GROUP BY ALL) SELECT family_id, CAST(least AS BIGINT) AS least, count(*) AS n_least FROM w JOIN m USING (family_id) WHERE w = least GROUP BY ALL")
def min_unique_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(6).select(F.col("id").alias("family_id")).crossJoin(enumerate.subsets(spark, 5).where("size = 2").select(F.col("mask").alias("set_id"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("(set_id >> k) & 1 = 1")
    family = rows.select("family_id", "set_id", (F.col("family_id") * 10 + F.col("k")).alias("item"))
    weights = spark.range(60).select(F.col("id").alias("item"), F.expr("(id % 10 + id div 10) * 3 % 7").alias("weight"))
    return sampling.min_unique(weights, family)


@R.add("geometric_waits", f"SELECT i AS k, CAST(floor(ln(1 - {unit_sql('11', 'i', '0')}) / ln(1 - 0.05::DOUBLE)) AS BIGINT) AS wait FROM range(500) t(i)")
def geometric_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(500).select(F.col("id").alias("k"), sampling.geometric(random_unit(11, F.col("id"), 0), F.lit(0.05)).alias("wait"))


@R.add("hypercube_toggles", f"SELECT c AS chain_id, s AS step, bit_xor(CASE WHEN {unit_sql('12', 'c * 100000 + s', '1')} < 0.5 THEN 1::BIGINT << CAST(floor({unit_sql('12', 'c * 100000 + s', '0')} * 10) AS INTEGER) ELSE 0 END) OVER (PARTITION BY c ORDER BY s) AS mask FROM range(5) a(c), range(1, 101) b(s)")
def hypercube_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chains

    return chains.toggles(spark, 10, 100, 5, 12)


@R.add("set_partitions")
def set_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.set_partitions(spark, 6, 300, 3).groupBy("sample_id").agg(F.countDistinct("urn").alias("n_blocks")).groupBy("n_blocks").agg(F.count("*").alias("n"))


def _specs(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT id AS chain_id, CASE WHEN id % 2 = 0 THEN 1.0D ELSE 2.0D END AS base, id + 1 AS seed FROM range(4)").repartition(4)


@R.add("flip_chain_trace")
def flip_chain_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chains

    return chains.flip_traces(_specs(spark), chains.FlipChain(8, 8), 400)


@R.add("flip_chain_summary")
def flip_chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chains

    return chains.summary(chains.flip_traces(_specs(spark), chains.FlipChain(8, 8), 400))


@R.add("flip_chain_occupancy")
def flip_chain_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chains

    return chains.occupancy(chains.flip_traces(_specs(spark), chains.FlipChain(8, 8), 400))
