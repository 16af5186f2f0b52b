"""Queries over the driver's tables, whole, with SQL for each: statistics, learners, estimators and the stream monitor."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import pair, random_unit
from ..operators import connect, enumerate, estimate, learn, statistics
from .graph_queries import unit_sql
from .registry import Registry

R = Registry()


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@R.add("nation_components", "SELECT comp, count(*) AS n FROM (SELECT min(c_custkey) OVER (PARTITION BY c_nationkey) AS comp FROM customer) GROUP BY comp")
def nation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), "c_nationkey")
    # Customers of a nation, chained by key: a path of up to all of them, not a star.
    from pyspark.sql import Window

    chain = c.select(F.col("node_id").alias("u"), F.lead("node_id").over(Window.partitionBy("c_nationkey").orderBy("node_id")).alias("v")).where("v IS NOT NULL")
    return connect.components(c, chain).groupBy("comp").agg(F.count("*").alias("n"))


@R.add("pendant_parts", "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT degree, count(*) AS n FROM (SELECT p, count(*) AS degree FROM e GROUP BY p) GROUP BY degree")
def pendant_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import Graph

    edges = t(spark, sf_dir, "lineitem").select((-F.col("l_suppkey") - 1).alias("u"), F.col("l_partkey").alias("v")).distinct()
    parts = edges.select(F.col("v").alias("node_id")).distinct()
    return Graph(parts, edges).degree().groupBy("degree").agg(F.count("*").alias("n"))


@R.add("mod2_terms", "SELECT l_partkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) % 2 = 1")
def mod2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enumerate.mod2(t(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@R.add("merge_sorted", "SELECT row_number() OVER (ORDER BY o_custkey, o_orderpriority, o_orderkey) - 1 AS place, o_orderpriority AS list_id, o_custkey AS v FROM orders")
def merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.merge_sorted(t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("list_id"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("v")))


@R.add("running_means", "SELECT event_id, user_id, count(value) OVER w AS n_so_far, CAST(floor(avg(value) OVER w * 10000 + 0.00001) AS BIGINT) AS mean_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = statistics.running_mean(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return r.select("event_id", "user_id", "n_so_far", F.floor(F.col("mean_so_far") * 10000 + 0.00001).alias("mean_so_far"))


@R.add("run_lengths", """
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT user_id, event_type, count(*) AS n, min(pos) AS start, max(pos) AS stop FROM r GROUP BY user_id, event_type, pos - k)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY start) AS run, n, start, stop FROM g""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.run_lengths(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


_GAPS = "SELECT user_id, event_id AS step, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS v FROM events"


@R.add("filled_series", f"""
WITH e AS ({_GAPS}), k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) OVER a AS t1, first_value(v IGNORE NULLS) OVER a AS v1 FROM e
WINDOW b AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, step, round(coalesce(v, v0 + (v1 - v0) * (step - t0) / CAST(t1 - t0 AS DOUBLE)), 6) AS filled FROM k""")
def filled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.when(F.col("event_type") != "click", F.col("value")).alias("v"))
    return statistics.fill_between(e, "user_id", "step", "v").select("user_id", "step", F.round("filled", 6).alias("filled"))


@R.add("value_histogram", "SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS value, count(*) AS cnt FROM events GROUP BY ALL")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(t(spark, sf_dir, "events"), ["event_type"], F.floor(F.col("value") / 10))


@R.add("summed_histograms", "SELECT CAST(floor(value / 10) AS BIGINT) AS value, count(*) AS cnt FROM events GROUP BY ALL")
def summed_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.sum_histograms(value_histogram(spark, sf_dir))


@R.add("supplier_outliers", "WITH f AS (SELECT l_suppkey, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS own FROM lineitem GROUP BY ALL) SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_extendedprice <= own) AS n_lower, count(*) FILTER (l_extendedprice <= own) <= 0.05 * count(*) AS outlier FROM lineitem JOIN f USING (l_suppkey) GROUP BY ALL")
def supplier_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    return statistics.epsilon_outlier(li, "l_suppkey", "at", "l_extendedprice", 0.05)


_PV = "SELECT event_type AS trial, event_id AS test_id, (row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 0.5) / count(*) OVER (PARTITION BY event_type) * (CASE WHEN event_id % 3 = 0 THEN 0.05 ELSE 1 END) AS p, CAST(event_id % 3 = 0 AS INTEGER) AS label FROM events"


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("event_type")
    rank = (F.row_number().over(w.orderBy("value", "event_id")) - 0.5) / F.count("*").over(w)
    return t(spark, sf_dir, "events").select(F.col("event_type").alias("trial"), F.col("event_id").alias("test_id"), (rank * F.when(F.col("event_id") % 3 == 0, 0.05).otherwise(1.0)).alias("p"), (F.col("event_id") % 3 == 0).cast("int").alias("label"))


_BH = f"WITH p AS (SELECT trial, test_id, CAST(p AS DOUBLE) AS p, label FROM ({_PV})), r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY p, test_id) AS j, count(*) OVER (PARTITION BY trial) AS n FROM p), l AS (SELECT trial, max(p) AS threshold FROM r WHERE p <= 0.1::DOUBLE * j / n GROUP BY trial), b AS (SELECT p.*, coalesce(threshold, 0) AS threshold, p <= coalesce(threshold, 0) AS rejected FROM p LEFT JOIN l USING (trial))"


@R.add("bh_rejections", f"{_BH} SELECT trial, test_id, label, round(p, 9) AS p, round(threshold, 9) AS threshold, rejected FROM b")
def bh_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = statistics.benjamini_hochberg(_p_values(spark, sf_dir), "trial", 0.1)
    return b.select("trial", "test_id", "label", F.round("p", 9).alias("p"), F.round("threshold", 9).alias("threshold"), "rejected")


@R.add("false_discoveries", f"{_BH} SELECT trial, count(*) FILTER (rejected AND label = 0) AS n_false, count(*) FILTER (rejected) AS n_rejected, round(coalesce(count(*) FILTER (rejected AND label = 0) / nullif(count(*) FILTER (rejected), 0), 0), 9) AS fdp FROM b GROUP BY trial")
def false_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = statistics.false_discoveries(statistics.benjamini_hochberg(_p_values(spark, sf_dir), "trial", 0.1), "trial")
    return d.withColumn("fdp", F.round("fdp", 9))


@R.add("order_rank_profile", "SELECT rank, count(*) AS n, min(p) AS lo, max(p) AS hi, round(avg(p), 4) AS mean FROM (SELECT l_extendedprice AS p, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS INTEGER) AS rank FROM lineitem) GROUP BY rank")
def order_rank_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.rank_profile(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice").withColumn("mean", F.round("mean", 4))


@R.add("circular_distances", "WITH a AS (SELECT i, i * 0.37::DOUBLE AS x, i * i * 0.11::DOUBLE AS y FROM range(200) t(i)), d AS (SELECT i, (x - y) - 2 * pi() * floor((x - y) / (2 * pi())) AS d FROM a) SELECT i, round(least(d, 2 * pi() - d), 6) AS d FROM d")
def circular_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(200).select(F.col("id").alias("i"), F.round(statistics.circular_distance(F.col("id") * 0.37, F.col("id") * F.col("id") * 0.11), 6).alias("d"))


@R.add("proportion_tests", "SELECT n_nationkey, round(abs(e - 0.5) / sqrt(0.25 / n), 6) AS z FROM (SELECT c_nationkey AS n_nationkey, avg(CASE WHEN c_acctbal > 4500 THEN 1.0 ELSE 0 END) AS e, count(*) AS n FROM customer GROUP BY ALL)")
def proportion_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg((F.col("c_acctbal") > 4500).cast("double")).alias("e"), F.count("*").alias("n"))
    return g.select("n_nationkey", F.round(statistics.proportion_test(F.lit(0.5), F.col("e"), F.col("n")), 6).alias("z"))


@R.add("preimage_intervals", "WITH RECURSIVE p(k, lo, hi) AS (SELECT 0, 0.12::DOUBLE, 0.52::DOUBLE UNION ALL SELECT k + 1, (lo + b) / 2, (hi + b) / 2 FROM p, (VALUES (0), (1)) v(b) WHERE k < 4) SELECT round(lo, 9) AS lo, round(hi, 9) AS hi FROM p WHERE k = 4")
def preimage_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql("SELECT 0 AS set_id, 0.12D AS lo, 0.52D AS hi")
    for _ in range(4):
        d = statistics.preimage(d)
    return d.select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@R.add("loop_erased_walks", f"""
WITH RECURSIVE w AS (SELECT i // 60 AS walk_id, i % 60 AS idx, CAST(floor({unit_sql('21', 'i // 60', 'i % 60')} * 25) AS BIGINT) AS node_id FROM range(1200) t(i)), l AS (SELECT *, max(idx) OVER (PARTITION BY walk_id, node_id) AS last FROM w),
e(walk_id, pos, idx) AS (SELECT walk_id, 0::BIGINT, 0::BIGINT FROM w WHERE idx = 0 UNION ALL SELECT e.walk_id, e.pos + 1, l.last + 1 FROM e JOIN l ON l.walk_id = e.walk_id AND l.idx = e.idx WHERE l.last < 59)
SELECT e.walk_id, e.pos, w.node_id FROM e JOIN w USING (walk_id, idx)""")
def loop_erased_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.range(1200).select(F.expr("id div 60").alias("walk_id"), F.expr("id % 60").alias("idx")).withColumn("node_id", F.floor(random_unit(21, F.col("walk_id"), F.col("idx")) * 25))
    return statistics.loop_erasure(w)


_ROWS = "SELECT d.doc_id, lang, source, CASE WHEN n_chars < 500 THEN 's' WHEN n_chars < 2000 THEN 'm' ELSE 'l' END AS size, CAST(l.quality AS VARCHAR) AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id"
_LONG = f"rows AS ({_ROWS}), data AS (SELECT doc_id AS row_id, y, unnest(['lang', 'size', 'source']) AS feature, unnest([lang, size, source]) AS value FROM rows), cls AS (SELECT y, count(*) AS n_y FROM rows GROUP BY y)"


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("n_chars") < 500, "s").when(F.col("n_chars") < 2000, "m").otherwise("l")
    rows = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", size.alias("size")).join(t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return learn.long_form(rows, "doc_id", ["lang", "size", "source"], "quality")


_NB = f"""WITH {_LONG}, grid AS (SELECT DISTINCT feature, value, c.y, c.n_y FROM data, cls c), fc AS (SELECT g.*, (SELECT count(*) FROM data d WHERE d.feature = g.feature AND d.value = g.value AND d.y = g.y) AS n, (SELECT count(DISTINCT value) FROM data d WHERE d.feature = g.feature) AS domain FROM grid g)"""


@R.add("nb_counts", f"{_NB} SELECT feature, value, y, n, n_y, domain, round((n + 1) / (n_y + domain)::DOUBLE, 9) AS p FROM fc")
def nb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.feature_counts(_data(spark, sf_dir)).withColumn("p", F.round("p", 9))


_POST = f"{_NB}, s AS (SELECT row_id, c.y, ln((c.n_y + 1) / ((SELECT sum(n_y) FROM cls) + (SELECT count(*) FROM cls))::DOUBLE) + sum(ln((n + 1) / (fc.n_y + domain)::DOUBLE)) AS s FROM data d JOIN fc USING (feature, value) JOIN cls c ON c.y = fc.y GROUP BY row_id, c.y, c.n_y), e AS (SELECT row_id, y, exp(s - max(s) OVER (PARTITION BY row_id)) AS e FROM s)"


@R.add("nb_posterior", f"{_POST} SELECT row_id, y, round(e / sum(e) OVER (PARTITION BY row_id), 9) AS posterior FROM e")
def nb_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return learn.naive_bayes(data, data).withColumn("posterior", F.round("posterior", 9))


@R.add("nb_confusion", f"{_POST}, p AS (SELECT row_id, arg_max(y, (round(e, 9), y)) AS pred FROM (SELECT row_id, y, e / sum(e) OVER (PARTITION BY row_id) AS e FROM e) GROUP BY row_id) SELECT r.y, pred, count(*) AS n FROM p JOIN rows r ON r.doc_id = p.row_id GROUP BY ALL")
def nb_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    best = learn.best_class(learn.naive_bayes(data, data), 9).withColumnRenamed("y", "pred")
    return data.select("row_id", "y").distinct().join(best, "row_id").groupBy("y", "pred").agg(F.count("*").alias("n"))


@R.add("cmi_matrix", f"""WITH {_LONG}, dom AS (SELECT feature, value FROM data GROUP BY ALL), k AS (SELECT feature, count(*) AS k FROM dom GROUP BY feature), tot AS (SELECT sum(n_y) AS nn, count(*) AS c FROM cls),
g AS (SELECT a.feature AS a, b.feature AS b, a.value AS va, b.value AS vb, c.y, c.n_y, ka.k AS ka, kb.k AS kb, (SELECT count(*) FROM data x JOIN data z USING (row_id) WHERE x.feature = a.feature AND x.value = a.value AND z.feature = b.feature AND z.value = b.value AND x.y = c.y) AS n, (SELECT count(*) FROM data x WHERE x.feature = a.feature AND x.value = a.value AND x.y = c.y) AS na, (SELECT count(*) FROM data x WHERE x.feature = b.feature AND x.value = b.value AND x.y = c.y) AS nb FROM dom a, dom b, cls c, k ka, k kb WHERE a.feature < b.feature AND ka.feature = a.feature AND kb.feature = b.feature)
SELECT a, b, round(sum((n + 1) / (tot.nn + ka * kb * tot.c)::DOUBLE * log2(((n + 1) / (n_y + ka * kb)::DOUBLE) / (((na + 1) / (n_y + ka)::DOUBLE) * ((nb + 1) / (n_y + kb)::DOUBLE)))), 9) AS cmi FROM (SELECT g.a, g.b, g.n, g.na, g.nb, g.ka, g.kb, g.n_y FROM g) g, tot GROUP BY a, b""")
def cmi_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.conditional_information(_data(spark, sf_dir)).withColumn("cmi", F.round("cmi", 9))


@R.add("tan_posterior", f"""WITH {_LONG}, par AS (SELECT d.*, coalesce(u.value, '') AS pv FROM data d LEFT JOIN data u ON u.row_id = d.row_id AND u.feature = CASE d.feature WHEN 'size' THEN 'lang' WHEN 'source' THEN 'lang' END),
s AS (SELECT p.row_id, c.y, ln((c.n_y + 1) / ((SELECT sum(n_y) FROM cls) + (SELECT count(*) FROM cls))::DOUBLE) + sum(ln((coalesce(n.n, 0) + 1) / (coalesce(m.m, 0) + k.k)::DOUBLE)) AS s FROM par p CROSS JOIN cls c
LEFT JOIN (SELECT feature, pv, value, y, count(*) AS n FROM par GROUP BY ALL) n ON n.feature = p.feature AND n.pv = p.pv AND n.value = p.value AND n.y = c.y LEFT JOIN (SELECT feature, pv, y, count(*) AS m FROM par GROUP BY ALL) m ON m.feature = p.feature AND m.pv = p.pv AND m.y = c.y JOIN (SELECT feature, count(DISTINCT value) AS k FROM data GROUP BY feature) k ON k.feature = p.feature GROUP BY p.row_id, c.y, c.n_y),
e AS (SELECT row_id, y, exp(s - max(s) OVER (PARTITION BY row_id)) AS e FROM s) SELECT row_id, y, round(e / sum(e) OVER (PARTITION BY row_id), 9) AS posterior FROM e""")
def tan_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return learn.tan_bayes(data, data, [("lang", "size"), ("lang", "source")]).withColumn("posterior", F.round("posterior", 9))


_SCORED = "SELECT CAST(d.doc_id * 37 % 101 AS DOUBLE) / 101 AS score, l.quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id"


@R.add("roc_points", f"WITH s AS ({_SCORED}), g AS (SELECT CAST(i AS INTEGER) AS t FROM range(21) r(i)), c AS (SELECT t, count(*) FILTER (label = 1 AND floor(score * 20 + 1e-9) >= t) AS tp, count(*) FILTER (label = 0 AND floor(score * 20 + 1e-9) >= t) AS fp, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM g, s GROUP BY t) SELECT t, tp, fp, p - tp AS fn, n - fp AS tn, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM c")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select(((F.col("doc_id") * 37 % 101).cast("double") / 101).alias("score"), F.col("quality").alias("label"))
    return learn.roc(s).withColumn("fpr", F.round("fpr", 9)).withColumn("tpr", F.round("tpr", 9))


@R.add("stratified_folds", "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, CAST(least(4, k // greatest(1, n // 5)) AS INTEGER) AS fold FROM r")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.folds(t(spark, sf_dir, "labels"), "doc_id", "quality", 5).select("doc_id", "quality", "fold")


@R.add("majority_votes", "WITH v AS (SELECT voter_id, list(m ORDER BY k) AS w FROM (SELECT voter_id, k, avg(x::DOUBLE) AS m FROM (SELECT vec_id % 9 AS voter_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY voter_id, k) GROUP BY voter_id), s AS (SELECT e.vec_id, voter_id, sign(round(list_sum(list_transform(list_zip(e.embedding, v.w), lambda q: q[1]::DOUBLE * q[2]::DOUBLE)), 9)) AS s FROM embeddings e, v) SELECT vec_id, count(*) FILTER (s > 0) AS n_for, count(*) AS n_voters, CAST(sign(sum(s)) AS INTEGER) AS vote FROM s GROUP BY vec_id")
def majority_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    means = e.select((F.col("vec_id") % 9).alias("voter_id"), F.posexplode("x").alias("k", "v")).groupBy("voter_id", "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
    voters = means.groupBy("voter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("w"))
    return learn.majority_vote(e, voters)


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


_H = [_sig("0.5::DOUBLE * a - 0.25::DOUBLE * b + 0.1::DOUBLE"), _sig("-0.3::DOUBLE * a + 0.8::DOUBLE * b - 0.2::DOUBLE")]


@R.add("network_activations", f"WITH x AS (SELECT c_custkey, c_acctbal / 10000 AS a, CAST(c_nationkey AS DOUBLE) / 25 AS b FROM customer) SELECT c_custkey, round({_sig(f'1.2::DOUBLE * {_H[0]} - 0.7::DOUBLE * {_H[1]} + 0.05::DOUBLE')}, 9) AS activation FROM x")
def network_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("a"), (F.col("c_nationkey").cast("double") / 25).alias("b"))
    hidden, out = np.array([[0.5, -0.25, 0.1], [-0.3, 0.8, -0.2]]), np.array([1.2, -0.7, 0.05])
    return learn.network_forward(x, ["a", "b"], hidden, out).select("c_custkey", F.round("activation", 9).alias("activation"))


@R.add("network_trained")
def network_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("a"), (F.col("c_nationkey").cast("double") / 25).alias("b")).withColumn("label", (F.col("a") > 0.45).cast("double"))
    hidden, out = learn.train_network(x, ["a", "b"], "label", epochs=10)
    return learn.network_forward(x, ["a", "b"], hidden, out).select("c_custkey", F.round("activation", 9).alias("activation"))


_DISC = "(SELECT a.i AS i, b.i AS j, a.i / 10.0::DOUBLE - 0.9 AS re, b.i / 10.0::DOUBLE - 0.9 AS im FROM range(19) a(i), range(19) b(i))"


@R.add("conformal_maps", f"WITH z AS (SELECT *, (1 - re) * (1 - re) + im * im AS d FROM {_DISC} WHERE re * re + im * im < 0.95) SELECT i, j, round(-2 * im / d, 6) AS up_re, round((1 - re * re - im * im) / d, 6) AS up_im, round(re, 6) AS back_re, round(im, 6) AS back_im FROM z")
def conformal_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = spark.range(361).select(F.expr("id div 19").alias("i"), F.expr("id % 19").alias("j")).withColumn("z", pair(F.col("i") / F.lit(10.0) - 0.9, F.col("j") / F.lit(10.0) - 0.9))
    z = z.where("z.re * z.re + z.im * z.im < 0.95").withColumn("up", estimate.map_up(F.col("z"))).withColumn("back", estimate.map_down(F.col("up")))
    return z.select("i", "j", *[(F.round(f"{c}.{p}", 6) + 0.0).alias(f"{c}_{p}") for c in ("up", "back") for p in ("re", "im")])


@R.add("hit_probabilities", "SELECT i AS k, round(1 - pow(1 - (i / 100.0::DOUBLE) * (i / 100.0::DOUBLE), 5 / 8.0::DOUBLE), 9) AS p FROM range(1, 100) t(i)")
def hit_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 100).select(F.col("id").alias("k"), F.round(estimate.hit_probability(F.col("id") / F.lit(100.0)), 9).alias("p"))


_MATRIX = "SELECT CAST(i // 25 AS INTEGER) AS m_id, CAST(i // 5 % 5 AS INTEGER) AS i, CAST(i % 5 AS INTEGER) AS j, CAST(i * 17 % 23 AS DOUBLE) / 23 AS v FROM range(100) t(i)"


def _matrices(spark: SparkSession) -> DataFrame:
    return spark.range(100).select(F.expr("cast(id div 25 as int)").alias("m_id"), F.expr("cast(id div 5 % 5 as int)").alias("i"), F.expr("cast(id % 5 as int)").alias("j"), ((F.col("id") * 17 % 23).cast("double") / 23).alias("v"))


@R.add("zero_sum_projection", f"SELECT m_id, i, j, round(v - avg(v) OVER (PARTITION BY m_id, i) - avg(v) OVER (PARTITION BY m_id, j) + avg(v) OVER (PARTITION BY m_id), 9) AS v FROM ({_MATRIX})")
def zero_sum_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.project_zero_sums(_matrices(spark)).withColumn("v", F.round("v", 9) + 0.0)


@R.add("doubly_stochastic", "SELECT CAST(k AS INTEGER) AS m_id, k < 3 AS ok FROM range(4) t(k)")
def doubly_stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.range(64).select(F.expr("cast(id div 16 as int)").alias("m_id"), F.expr("cast(id div 4 % 4 as int)").alias("i"), F.expr("cast(id % 4 as int)").alias("j"))
    v = F.expr("CASE m_id WHEN 0 THEN 0.25D WHEN 1 THEN CASE WHEN i = j THEN 1D ELSE 0D END WHEN 2 THEN CASE WHEN (i + j) % 4 IN (0, 1) THEN 0.5D ELSE 0D END ELSE 0.3D END")
    return estimate.doubly_stochastic(m.withColumn("v", v))


@R.add("matrix_squares", f"WITH m AS ({_MATRIX}) SELECT a.i, b.j, round(sum(a.v * b.v), 9) AS v FROM m a JOIN m b ON a.m_id = 0 AND b.m_id = 1 AND b.i = a.j GROUP BY a.i, b.j")
def matrix_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrices(spark)
    return estimate.matmul(m.where("m_id = 0").select("i", F.col("j").alias("k"), "v"), m.where("m_id = 1").select(F.col("i").alias("k"), "j", "v")).withColumn("v", F.round("v", 9))


@R.add("scatter_matrix", "WITH a AS (SELECT avg(l_quantity) AS a0, avg(l_discount) AS a1, avg(l_tax) AS a2 FROM lineitem), d AS (SELECT [l_quantity - a0, l_discount - a1, l_tax - a2] AS x FROM lineitem, a) SELECT CAST(p.i AS INTEGER) AS i, CAST(q.i AS INTEGER) AS j, round(sum(x[p.i + 1] * x[q.i + 1]), 3) AS v FROM d, range(3) p(i), range(3) q(i) GROUP BY ALL")
def scatter_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.scatter_matrix(t(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity", "l_discount", "l_tax"]).withColumn("v", F.round("v", 3) + 0.0)


@R.add("importance_ratio", "SELECT round(avg(l_extendedprice / l_quantity), 4) AS total, round(avg(1 / l_quantity), 9) AS size, round(avg(l_extendedprice / l_quantity) / avg(1 / l_quantity), 3) AS ratio FROM lineitem")
def importance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = estimate.importance_ratio(t(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity"))
    return r.select(F.round("total", 4).alias("total"), F.round("size", 9).alias("size"), F.round("ratio", 3).alias("ratio"))




@R.add("binomial_row", "WITH RECURSIVE p(n, k, c) AS (SELECT 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, k, CAST(sum(c) AS BIGINT) FROM (SELECT n, k, c FROM p UNION ALL SELECT n, k + 1, c FROM p) WHERE n < 30 GROUP BY n, k) SELECT k, c FROM p WHERE n = 30")
def binomial_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.combinatorics import binomials

    return binomials(spark, 30)


@R.add("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.monitor import windowed_counts

    return windowed_counts(spark, sf_dir)
