"""Small learners as grouped counts: naive and tree-augmented Bayes, ROC curves, folds, votes, and a one-layer network."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import dense_ids


def long_form(rows: DataFrame, row_id: str, features: list[str], label: str) -> DataFrame:
    """(row_id, feature, value, y): a row for each feature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
    return rows.select(F.col(row_id).alias("row_id"), F.col(label).cast("string").alias("y"), F.explode(pairs).alias("p")).select("row_id", "p.feature", "p.value", "y")


def class_counts(data: DataFrame) -> DataFrame:
    return data.select("row_id", "y").distinct().groupBy("y").agg(F.count("*").alias("n_y"))


def feature_counts(data: DataFrame) -> DataFrame:
    """(feature, value, y, n, n_y, domain, p): counts of each value and class, 0 where they don't meet, and Laplace's probability of the value in the class."""
    seen = data.groupBy("feature", "value", "y").agg(F.count("*").alias("n"))
    domain = data.groupBy("feature").agg(F.countDistinct("value").alias("domain"))
    grid = seen.select("feature", "value").distinct().join(F.broadcast(class_counts(data)))
    full = grid.join(seen, ["feature", "value", "y"], "left").join(F.broadcast(domain), "feature").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("feature", "value", "y", "n", "n_y", "domain", ((F.col("n") + 1) / (F.col("n_y") + F.col("domain"))).alias("p"))


def naive_bayes(train: DataFrame, test: DataFrame) -> DataFrame:
    """(row_id, y, posterior) of test(row_id, feature, value): classes' Laplace priors times the values' probabilities; unseen values count as no evidence."""
    counts = class_counts(train)
    k = counts.agg(F.count("*").alias("k"), F.sum("n_y").alias("total"))
    prior = counts.join(F.broadcast(k)).select("y", F.log((F.col("n_y") + 1) / (F.col("total") + F.col("k"))).alias("prior"))
    table = feature_counts(train).select("feature", "value", "y", F.log("p").alias("lp"))
    evidence = test.select("row_id", "feature", "value").join(table, ["feature", "value"]).groupBy("row_id", "y").agg(F.sum("lp").alias("lp"))
    every = test.select("row_id").distinct().join(F.broadcast(prior))
    score = every.join(evidence, ["row_id", "y"], "left").select("row_id", "y", (F.col("prior") + F.coalesce("lp", F.lit(0.0))).alias("s"))
    top = score.groupBy("row_id").agg(F.max("s").alias("top"))
    e = score.join(top, "row_id").withColumn("e", F.exp(F.col("s") - F.col("top")))
    total = e.groupBy("row_id").agg(F.sum("e").alias("z"))
    return e.join(total, "row_id").select("row_id", "y", (F.col("e") / F.col("z")).alias("posterior"))


def best_class(posterior: DataFrame, digits: int = 12) -> DataFrame:
    """(row_id, y): the class of largest posterior; of ties the last."""
    return posterior.groupBy("row_id").agg(F.max(F.struct(F.round("posterior", digits).alias("p"), "y")).alias("m")).select("row_id", F.col("m.y").alias("y"))


def conditional_information(data: DataFrame) -> DataFrame:
    """(a, b, cmi): for features a < b, I(a; b | class) in bits, with Laplace's counts over the values that occur."""
    pairs = data.alias("l").join(data.alias("r"), F.expr("l.row_id = r.row_id AND l.feature < r.feature")).select(F.col("l.feature").alias("a"), F.col("r.feature").alias("b"), F.col("l.value").alias("va"), F.col("r.value").alias("vb"), F.col("l.y").alias("y"))
    values = data.groupBy("feature").agg(F.collect_set("value").alias("vals"))
    classes = class_counts(data)
    total = classes.agg(F.sum("n_y").alias("total"), F.count("*").alias("k"))
    n = pairs.groupBy("a", "b", "va", "vb", "y").agg(F.count("*").alias("n"))
    left, right = values.select(F.col("feature").alias("a"), F.col("vals").alias("as")), values.select(F.col("feature").alias("b"), F.col("vals").alias("bs"))
    grid = left.join(right, F.expr("a < b")).join(F.broadcast(classes)).join(F.broadcast(total)).withColumn("ka", F.size("as")).withColumn("kb", F.size("bs"))
    grid = grid.withColumn("va", F.explode("as")).withColumn("vb", F.explode("bs")).drop("as", "bs")
    one = data.groupBy("feature", "value", "y").agg(F.count("*").alias("n"))
    na, nb = (one.select(F.col("feature").alias(x), F.col("value").alias(f"v{x}"), "y", F.col("n").alias(f"n{x}")) for x in "ab")
    g = grid.join(n, ["a", "b", "va", "vb", "y"], "left").join(na, ["a", "va", "y"], "left").join(nb, ["b", "vb", "y"], "left").fillna(0, ["n", "na", "nb"])
    joint = (F.col("n") + 1) / (F.col("total") + F.col("ka") * F.col("kb") * F.col("k"))
    both = (F.col("n") + 1) / (F.col("n_y") + F.col("ka") * F.col("kb"))
    pa, pb = (F.col("na") + 1) / (F.col("n_y") + F.col("ka")), (F.col("nb") + 1) / (F.col("n_y") + F.col("kb"))
    return g.groupBy("a", "b").agg(F.sum(joint * F.log2(both / (pa * pb))).alias("cmi"))


def max_spanning_tree(edges: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """Prim's tree over features, few by nature: from the first, the heaviest edge out, ties to the lower names."""
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    weight = {frozenset((a, b)): w for a, b, w in edges}
    inside, out = names[:1], []
    while len(inside) < len(names):
        _, a, b = min((-weight[frozenset((a, b))], a, b) for a in inside for b in names if b not in inside)
        inside.append(b)
        out.append((a, b))
    return out


def tan_bayes(train: DataFrame, test: DataFrame, parents: list[tuple[str, str]]) -> DataFrame:
    """(row_id, y, posterior) by tree-augmented Bayes: parents are (parent, feature) pairs, the rest depend on the class alone."""
    of = dict((b, a) for a, b in parents)
    tree = F.create_map(*[F.lit(x) for b, a in of.items() for x in (b, a)]) if of else None
    parent = lambda d: d.withColumn("parent", tree[F.col("feature")] if tree is not None else F.lit(None).cast("string"))

    def with_parent(d: DataFrame) -> DataFrame:
        up = d.select("row_id", F.col("feature").alias("parent"), F.col("value").alias("pv"))
        return parent(d).join(up, ["row_id", "parent"], "left").withColumn("pv", F.coalesce("pv", F.lit("")))

    t = with_parent(train)
    n = t.groupBy("feature", "pv", "value", "y").agg(F.count("*").alias("n"))
    base = t.groupBy("feature", "pv", "y").agg(F.count("*").alias("m"))
    domain = train.groupBy("feature").agg(F.countDistinct("value").alias("domain"))
    counts = class_counts(train)
    k = counts.agg(F.count("*").alias("k"), F.sum("n_y").alias("total"))
    prior = counts.join(F.broadcast(k)).select("y", F.log((F.col("n_y") + 1) / (F.col("total") + F.col("k"))).alias("prior"))
    rows = with_parent(test.select("row_id", "feature", "value")).join(F.broadcast(prior))
    rows = rows.join(n, ["feature", "pv", "value", "y"], "left").join(base, ["feature", "pv", "y"], "left").join(F.broadcast(domain), "feature").fillna(0, ["n", "m"])
    s = rows.groupBy("row_id", "y", "prior").agg(F.sum(F.log((F.col("n") + 1) / (F.col("m") + F.col("domain")))).alias("lp")).select("row_id", "y", (F.col("prior") + F.col("lp")).alias("s"))
    e = s.join(s.groupBy("row_id").agg(F.max("s").alias("top")), "row_id").withColumn("e", F.exp(F.col("s") - F.col("top")))
    return e.join(e.groupBy("row_id").agg(F.sum("e").alias("z")), "row_id").select("row_id", "y", (F.col("e") / F.col("z")).alias("posterior"))


def roc(scored: DataFrame, thresholds: int = 20) -> DataFrame:
    """(t, tp, fp, fn, tn, fpr, tpr) of scored(score, label 0/1) at thresholds 0 to 1; a rate of an empty class is 0. One pass:
    scores are counted by the thresholds they reach, then summed from above."""
    bucket = F.least(F.lit(thresholds), F.greatest(F.lit(-1), F.floor(F.col("score") * thresholds + 1e-9))).cast("int")
    n = scored.groupBy(bucket.alias("b")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    grid = scored.sparkSession.range(thresholds + 1).select(F.col("id").cast("int").alias("t"))
    at = grid.join(F.broadcast(n), F.expr("b >= t"), "left").groupBy("t").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    total = n.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.coalesce(F.sum("neg"), F.lit(0)).alias("N"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return at.join(F.broadcast(total)).select(
        "t", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp")], (F.col("P") - F.col("tp")).cast("long").alias("fn"), (F.col("N") - F.col("fp")).cast("long").alias("tn"), rate("fp", "N").alias("fpr"), rate("tp", "P").alias("tpr")
    )


def folds(rows: DataFrame, row_id: str, label: str, n: int) -> DataFrame:
    """rows with ``fold``: each class dealt into n contiguous folds by order of row_id, the remainder in the last."""
    from pyspark.sql import Window

    w = Window.partitionBy(label)
    r = rows.withColumn("_r", F.row_number().over(w.orderBy(row_id)) - 1).withColumn("_n", F.count("*").over(w))
    return r.withColumn("fold", F.least(F.lit(n - 1), F.expr(f"cast(_r div greatest(1, _n div {n}) as int)"))).drop("_r", "_n")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def majority_vote(vectors: DataFrame, voters: DataFrame) -> DataFrame:
    """(vec_id, n_for, n_voters, vote): the sign of the mean of the signs of voters(voter_id, w) on vectors(vec_id, x). The few voters are one broadcast array."""
    panel = voters.agg(F.sort_array(F.collect_list(F.struct("voter_id", "w"))).alias("panel"))
    v = vectors.join(F.broadcast(panel)).withColumn("signs", F.transform("panel", lambda p: F.signum(F.round(dot(p["w"], F.col("x")), 9))))
    v = v.withColumn("total", F.aggregate("signs", F.lit(0.0), lambda s, x: s + x))
    return v.select("vec_id", F.size(F.filter("signs", lambda s: s > 0)).cast("long").alias("n_for"), F.size("signs").cast("long").alias("n_voters"), F.signum("total").cast("int").alias("vote"))


def sigmoid(x: Column) -> Column:
    return F.when(x < -700, F.lit(0.0)).otherwise(1 / (1 + F.exp(-x)))


def network_forward(rows: DataFrame, features: list[str], hidden: np.ndarray, out: np.ndarray) -> DataFrame:
    """rows with ``activation``: a network of one hidden layer, weights as literals; the last column of each layer is the bias."""
    unit = lambda w, xs: sigmoid(reduce(lambda a, b: a + b, [F.lit(float(c)) * x for c, x in zip(w, xs)], F.lit(float(w[-1]))))
    layer = [unit(w, [F.col(f).cast("double") for f in features]) for w in hidden]
    with_layer = rows.withColumn("_h", F.array(*layer))
    return with_layer.withColumn("activation", unit(out, [F.col("_h")[k] for k in range(len(hidden))])).drop("_h")


def train_network(rows: DataFrame, features: list[str], label: str, width: int | None = None, rate: float = 0.5, epochs: int = 20, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch gradient descent: each epoch is one aggregation of the examples' summed gradients, so that only weights leave the executors."""
    rng = np.random.default_rng(seed)
    n, width = len(features), width or len(features)
    hidden, out = rng.uniform(0, 0.1, (width, n + 1)), rng.uniform(0, 0.1, width + 1)
    xs = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    for _ in range(epochs):
        d = network_forward(rows, features, hidden, out)
        h = [sigmoid(reduce(lambda a, b: a + b, [F.lit(float(c)) * x for c, x in zip(w, xs)])) for w in hidden]
        d = d.withColumn("_h", F.array(*h, F.lit(1.0))).withColumn("_e", F.col("activation") - F.col(label)).withColumn("_d", F.col("_e"))
        sums = [F.avg(F.col("_d") * F.col("_h")[k]).alias(f"o{k}") for k in range(width + 1)]
        sums += [F.avg(F.col("_d") * float(out[k]) * F.col("_h")[k] * (1 - F.col("_h")[k]) * xs[j]).alias(f"h{k}_{j}") for k in range(width) for j in range(n + 1)]
        g = d.agg(*sums).first()
        out = out - rate * np.array([g[f"o{k}"] for k in range(width + 1)])
        hidden = hidden - rate * np.array([[g[f"h{k}_{j}"] for j in range(n + 1)] for k in range(width)])
    return hidden, out


def class_totals(data: DataFrame) -> DataFrame:
    """(feature, y, n): how many values of a feature a class has, of data(row_id, feature, value, y)."""
    return data.groupBy("feature", "y").agg(F.count("value").alias("n"))


def tree_weight(tree: DataFrame) -> DataFrame:
    """One row: the sum of the weights of tree(.., weight); 0 if it has none."""
    return tree.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))


def restored_order(results: DataFrame, fold: DataFrame) -> DataFrame:
    """(row_id, value): results(i, value), numbered through folds one after the other and by row_id within each, back at the rows of fold(row_id, fold)."""
    return dense_ids(fold.select("fold", "row_id"), "fold", "row_id", name="i").join(results, "i").select("row_id", "value")
