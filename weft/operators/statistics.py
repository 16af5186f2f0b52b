"""Statistics of plans, series and samples; windows and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import dense_ids


def cut_edges(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, u, v, du, dv): edges whose ends are in different districts of plan(plan_id, node_id, district)."""
    a = plan.select("plan_id", F.col("node_id").alias("u"), F.col("district").alias("du"))
    b = plan.select("plan_id", F.col("node_id").alias("v"), F.col("district").alias("dv"))
    return edges.join(a, "u").join(b, ["plan_id", "v"]).where("du <> dv").select("plan_id", "u", "v", "du", "dv")


def cut_size(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, n_cut), 0 for plans without cut edges."""
    n = cut_edges(plan, edges).groupBy("plan_id").agg(F.count("*").alias("n"))
    return plan.select("plan_id").distinct().join(n, "plan_id", "left").select("plan_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_cut"))


def slope(cut: DataFrame, nodes: DataFrame) -> DataFrame:
    """(plan_id, dx, dy): summed displacements over the cut edges, from the lower to the higher district."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    sign = F.when(F.col("du") < F.col("dv"), 1).otherwise(-1)
    return cut.join(a, "u").join(b, "v").groupBy("plan_id").agg(F.sum(sign * (F.col("vx") - F.col("ux"))).cast("long").alias("dx"), F.sum(sign * (F.col("vy") - F.col("uy"))).cast("long").alias("dy"))


def seats(plan: DataFrame, votes: DataFrame) -> DataFrame:
    """(plan_id, district, margin, seat): votes(node_id, vote 0/1); seat is the sign of the margin."""
    m = plan.join(votes, "node_id").groupBy("plan_id", "district").agg(F.sum(2 * F.col("vote") - 1).cast("long").alias("margin"))
    return m.withColumn("seat", F.signum("margin").cast("int"))


def fair(seat: DataFrame) -> DataFrame:
    """(plan_id, fair): 1 if the seats balance."""
    return seat.groupBy("plan_id").agg(F.sum("seat").alias("s")).select("plan_id", F.when(F.col("s") == 0, 1).otherwise(0).cast("int").alias("fair"))


def boundary_nodes(cut: DataFrame) -> DataFrame:
    """(plan_id, node_id, other): ends of cut edges with the district across."""
    return cut.select("plan_id", F.col("u").alias("node_id"), F.col("dv").alias("other")).union(cut.select("plan_id", "v", "du")).distinct()


def running_mean(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("n_so_far", F.count(value).over(w)).withColumn("mean_so_far", F.avg(value).over(w))


def run_lengths(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value, run, n, start, stop): maximal runs of equal values in order; start and stop are row numbers from 0."""
    w = Window.partitionBy(key).orderBy(*order)
    r = rows.select(key, value, (F.row_number().over(w) - 1).alias("pos"), F.lag(value).over(w).alias("prev"))
    r = r.withColumn("run", F.sum(F.when(F.col("prev").eqNullSafe(F.col(value)), 0).otherwise(1)).over(Window.partitionBy(key).orderBy("pos")).cast("long"))
    return r.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min("pos").cast("long").alias("start"), F.max("pos").cast("long").alias("stop"))


def fill_between(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Null values of a series interpolated linearly between the known ones next to them; before the first and after the last they stay null."""
    back = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    r = rows.withColumn("_t0", F.last(known, True).over(back)).withColumn("_v0", F.last(value, True).over(back)).withColumn("_t1", F.first(known, True).over(ahead)).withColumn("_v1", F.first(value, True).over(ahead))
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(order) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    return r.withColumn("filled", F.coalesce(F.col(value), line)).drop("_t0", "_v0", "_t1", "_v1")


def histogram(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return rows.groupBy(*keys, value.alias("value")).agg(F.count("*").alias("cnt"))


def sum_histograms(h: DataFrame) -> DataFrame:
    return h.groupBy("value").agg(F.sum("cnt").cast("long").alias("cnt"))


def epsilon_outlier(rows: DataFrame, key: str, order: str, value: str, epsilon: float) -> DataFrame:
    """(key, n, n_lower, outlier): whether the first value of a key is within the lowest share epsilon of all its values."""
    first = rows.groupBy(key).agg(F.min_by(value, order).alias("own"))
    both = rows.join(first, key).groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(value) <= F.col("own")).alias("n_lower"))
    return both.withColumn("outlier", F.col("n_lower") <= epsilon * F.col("n"))


def benjamini_hochberg(p: DataFrame, trial: str, q: float) -> DataFrame:
    """p(trial.., test_id, p) with threshold and rejected: the largest p of rank j (from 1) with p <= q * j / N; ties by test_id."""
    w = Window.partitionBy(trial).orderBy("p", "test_id")
    ranked = p.withColumn("j", F.row_number().over(w)).withColumn("N", F.count("*").over(Window.partitionBy(trial)))
    limit = ranked.where(F.col("p") <= q * F.col("j") / F.col("N")).groupBy(trial).agg(F.max("p").alias("threshold"))
    out = p.join(limit, trial, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    return out.withColumn("rejected", F.col("p") <= F.col("threshold"))


def false_discoveries(results: DataFrame, trial: str) -> DataFrame:
    """(trial, n_false, n_rejected, fdp) of results(trial, rejected, label: 1 where an effect is); 0 if nothing is rejected."""
    g = results.groupBy(trial).agg(F.count_if(F.col("rejected") & (F.col("label") == 0)).alias("n_false"), F.count_if("rejected").alias("n_rejected"))
    return g.withColumn("fdp", F.when(F.col("n_rejected") > 0, F.col("n_false") / F.col("n_rejected")).otherwise(0.0))


def circular_distance(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(2 * 3.141592653589793))
    return F.least(d, F.lit(2 * 3.141592653589793) - d)


def proportion_test(true: Column, estimate: Column, n: Column) -> Column:
    """Standardised difference of a proportion."""
    return F.abs(estimate - true) / F.sqrt(true * (1 - true) / n)


def preimage(intervals: DataFrame) -> DataFrame:
    """Preimages of intervals(set_id, lo, hi) of [0, 1] under doubling modulo 1."""
    return intervals.select("set_id", F.explode(F.array(*[F.struct(((F.col("lo") + k) / 2).alias("lo"), ((F.col("hi") + k) / 2).alias("hi")) for k in (0, 1)])).alias("p")).select("set_id", "p.lo", "p.hi")


def rank_profile(rows: DataFrame, plan: str, value: str) -> DataFrame:
    """(rank, n, lo, hi, mean): values sorted within each plan, then summed up by rank, as for a box plot."""
    r = rows.withColumn("rank", F.row_number().over(Window.partitionBy(plan).orderBy(value)))
    return r.groupBy("rank").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))


def loop_erasure(walk: DataFrame) -> DataFrame:
    """(walk_id, pos, node_id): chronological loop erasure of walk(walk_id, idx, node_id). From each kept step the walk goes on after the
    node's last visit, so that following last visits from the start gives the path; by pointer rounds, not step by step."""
    w = Window.partitionBy("walk_id", "node_id")
    steps = walk.withColumn("last", F.max("idx").over(w)).select("walk_id", "idx", "node_id", (F.col("last") + 1).alias("to"))
    ends = walk.groupBy("walk_id").agg(F.max("idx").alias("end"))
    steps = steps.join(ends, "walk_id")
    reached = steps.where("idx = 0").select("walk_id", "idx", F.lit(0).cast("long").alias("pos"))
    jump, size = steps.select("walk_id", "idx", "to"), 1
    while True:  # jump goes 2**k kept steps ahead
        more = reached.join(jump, ["walk_id", "idx"]).select("walk_id", F.col("to").alias("idx"), (F.col("pos") + size).alias("pos"))
        more = more.join(walk.select("walk_id", "idx"), ["walk_id", "idx"], "left_semi")
        if not more.limit(1).count():
            break
        reached = reached.union(more).checkpoint()
        jump = jump.alias("a").join(jump.alias("b"), F.expr("a.walk_id = b.walk_id AND a.to = b.idx")).select("a.walk_id", "a.idx", "b.to").checkpoint()
        size *= 2
    return reached.join(walk, ["walk_id", "idx"]).select("walk_id", "pos", "node_id")


def oriented_pairs(series: DataFrame) -> DataFrame:
    """(series_id, pos, ax, ay, bx, by): the pairs of points of series(series_id, pos, ax, ay, bx, by), the first as it is and each later one turned
    round if its second point is within 1 of the first point of the pair before, as that stands then. A step either sets the turn, keeps
    it or reverses it, so that the turn at a place is what was set last and the parity of the reversals since: windows, no loop."""
    w = Window.partitionBy("series_id").orderBy("pos")
    near = lambda p: F.pow(F.col("bx") - F.lag(f"{p}x").over(w), 2) + F.pow(F.col("by") - F.lag(f"{p}y").over(w), 2) <= 1
    s = series.withColumns({"_plain": F.coalesce(near("a"), F.lit(False)), "_turned": F.coalesce(near("b"), F.lit(False))})
    s = s.withColumn("_sets", F.col("_plain") == F.col("_turned")).withColumn("_run", F.sum(F.col("_sets").cast("int")).over(w))
    since = Window.partitionBy("series_id", "_run").orderBy("pos")
    reversals = F.sum((F.col("_plain") & ~F.col("_turned")).cast("int")).over(since)
    s = s.withColumn("_turn", F.pmod(F.first("_plain").over(since).cast("int") + reversals, F.lit(2)) == 1)
    either = lambda p, q: F.when(F.col("_turn"), F.col(q)).otherwise(F.col(p)).alias(p)
    return s.select("series_id", "pos", either("ax", "bx"), either("ay", "by"), either("bx", "ax"), either("by", "ay"))


def block_cut(blocks: DataFrame, edges: DataFrame, power: float = 1) -> DataFrame:
    """(block_id, value): the number of edges(u, v) with one end in the block, to a power; 1 for power 0."""
    cells = blocks.select("block_id", "node_id").distinct()
    both = edges.select(F.col("u").alias("node_id"), F.col("v").alias("other")).union(edges.select("v", "u"))
    out = cells.join(both, "node_id").join(cells.select("block_id", F.col("node_id").alias("other")), ["block_id", "other"], "left_anti").groupBy("block_id").agg(F.count("*").alias("n"))
    return cells.select("block_id").distinct().join(out, "block_id", "left").select("block_id", F.pow(F.coalesce("n", F.lit(0)).cast("double"), F.lit(float(power))).alias("value"))


def merge_sorted(lists: DataFrame) -> DataFrame:
    """(place, list_id, v): lists(list_id, pos, v) merged; places by range partitions and their sizes, not in one task."""
    return dense_ids(lists.select("list_id", "pos", "v"), "v", "list_id", "pos", name="place").select("place", "list_id", "v")
