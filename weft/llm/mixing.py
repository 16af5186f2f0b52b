"""Mixing sources to target weights: budgets flow down a tree of domains, languages and sources, and each source gives a
token-prefix of its documents in a seeded order, over as many epochs as its budget takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Stored, pick, spare

LEVELS = ("domain", "lang", "source")
WORDS = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A row's place in an epoch's order, 60 bits; rows of one doc_id share theirs."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def fill(children: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """children(parent.., name, cap, weight) with ``got``: each child's share of its parent's budget by weight, its capacity
    at most; what it can't take goes to its siblings by weight. Whole tokens, rounded down; weight 0 gets nothing."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = by.orderBy("_ratio", "name")
    d = "decimal(38,0)"
    rows = children.withColumn("_budget", budget).where("weight > 0").withColumn("_ratio", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("_before", F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_weights", F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_full", F.col("cap").cast(d) * F.col("_weights") <= (F.col("_budget") - F.col("_before")).cast(d) * F.col("weight"))
    rows = rows.withColumn("_taken", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(by)).withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(by))
    share = F.expr(f"cast(greatest(_budget - _taken, 0) as {d}) * weight div greatest(_open, 1)")
    return rows.withColumn("got", F.when(F.col("_full"), F.col("cap")).otherwise(F.least("cap", share))).drop("_budget", "_ratio", "_before", "_weights", "_full", "_taken", "_open")


def budgets(leaves: DataFrame, weights: DataFrame | None, budget: int | Column, max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens) with ``got``, each leaf's budget. Shortages go to sources of the same language and
    domain first, then to its other languages, then to other domains: a node's capacity is that of all leaves below it.

    weights(domain, lang, source, weight): whole weights of nodes; a language's has a null source, a domain's a null language
    too. Nodes without one weigh 1.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    found = None
    for depth in range(1, len(LEVELS) + 1):
        path = list(LEVELS[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("name", F.col(path[-1]))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(1).cast("long"))
        else:
            own = weights.where(F.expr(" AND ".join([*(f"{x} IS NOT NULL" for x in path), *(f"{x} IS NULL" for x in LEVELS[depth:])]) or "true"))
            own = own.groupBy(*path).agg(F.max("weight").cast("long").alias("weight"))
            nodes = nodes.join(own, path, "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))
        if found is None:
            found = fill(nodes, [], budget if isinstance(budget, Column) else F.lit(budget).cast("long"))
        else:
            above = found.select(*path[:-1], F.col("got").alias("_above"))
            found = fill(nodes.join(above, path[:-1]), path[:-1], F.col("_above")).drop("_above")
        found = found.select(*path, "got")
    return leaves.join(found, list(LEVELS)).select(*LEVELS, "tokens", "got")


def mix(
    docs: DataFrame, domain: Column, weights: DataFrame | None = None, share: tuple[int, int] = (3, 5), max_epochs: int = 2, seed: int = 7, buckets: int = 1024
) -> DataFrame:
    """The rows of docs(doc_id, text, lang, source), all columns, once for each epoch in which they're chosen, with n_tokens and epoch.

    The whole budget is share[0] / share[1] of all tokens (words). A leaf whose budget is k times its tokens and r more gives
    all its rows in epochs 0 to k - 1, and in epoch k the rows, in that epoch's order, whose running sum of tokens is r at
    most. Rows of one doc_id in a leaf come together, in or out. Null and empty lang, source or domain are the same node; a null text
    has no tokens and comes with its leaf's others; a leaf without tokens gives nothing. An empty table gives an empty one.
    Columns named n_tokens, epoch and domain, in upper or lower case, are replaced; names of other columns don't matter.

    No task holds a leaf: running sums are taken over ``buckets`` ranges of the order first, then within the one range where
    a leaf's budget ends. The plan of a leaf is one row, joined to the documents in whatever way its size allows.
    """
    spark, store = docs.sparkSession, Stored(docs.sparkSession, "mix")
    pick(docs, "doc_id", "text", *LEVELS[1:])
    node = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    columns = [c for c in docs.columns if c.lower() not in ("n_tokens", "epoch", "domain")]
    lang, origin, d, l, s, full, stop, n = spare(docs, "_lang", "_source", "_d", "_l", "_s", "_full", "_stop", "_n")  # noqa: E741
    source = docs.select(*[f"`{c}`" for c in columns], node(domain).alias("domain"), node(F.col("lang")).alias(lang), node(F.col("source")).alias(origin), n_tokens(F.col("text")).alias("n_tokens"))
    rows = store.write(source.select("doc_id", "domain", F.col(lang).alias("lang"), F.col(origin).alias("source"), "n_tokens"), "rows")
    leaves = store.write(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    got = budgets(leaves, weights, total * share[0] // share[1], max_epochs)
    plan = store.write(got.where("got > 0").withColumn("full", F.expr("got div tokens")).withColumn("rest", F.expr("got % tokens")).select(*LEVELS, "full", "rest"), "plan")

    part = rows.join(plan.where("rest > 0"), list(LEVELS)).withColumn("key", order_key(seed, F.col("full"), F.col("doc_id"))).withColumn("bucket", F.expr(f"key div {(1 << 60) // buckets}"))
    part = store.write(part.select(*LEVELS, "rest", "key", "bucket", "n_tokens"), "part")
    sums = part.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    ends = sums.withColumn("upto", running).where("upto > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before")), "bucket").alias("end"))
    ends = store.write(ends.select(*LEVELS, "end.bucket", "end.before"), "ends")
    last = part.join(ends, [*LEVELS, "bucket"])
    keys = last.groupBy(*LEVELS, "key", "rest", "before").agg(F.sum("n_tokens").alias("tokens"))
    keys = keys.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("key"))).where("upto > rest").groupBy(*LEVELS).agg(F.min("key").alias("stop"))
    # Rows of the epoch's order that come before the first that would go beyond the budget; where none would, the plan has no such epoch.
    plan = store.write(plan.join(keys, list(LEVELS), "left").select(F.col("domain").alias(d), F.col("lang").alias(l), F.col("source").alias(s), F.col("full").alias(full), F.col("stop").alias(stop)), "whole-plan")
    chosen = source.join(plan, (F.col("domain") == F.col(d)) & (F.col(lang) == F.col(l)) & (F.col(origin) == F.col(s)))
    epochs = F.col(full) + F.when(order_key(seed, F.col(full), F.col("doc_id")) < F.col(stop), 1).otherwise(0)
    chosen = chosen.withColumn(n, epochs).where(F.col(n) > 0)
    return chosen.select(*[F.col(f"`{c}`") for c in columns], "domain", "n_tokens", F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))).alias("epoch"))


def default_domain(source: Column) -> Column:
    """The domain of a source: its number modulo 4; sources without a number are of none."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("")).otherwise(F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")))


# Production weights: of domains and of one language in each.
WEIGHTS = [("d0", None, 4), ("d1", None, 3), ("d2", None, 2), ("d3", None, 1), ("d0", "en", 2), ("d1", "en", 2), ("d2", "en", 2), ("d3", "en", 2)]


def default_weights(spark) -> DataFrame:
    values = ", ".join(f"('{d}', {'NULL' if lang is None else repr(lang)}, {w})" for d, lang, w in WEIGHTS)
    return spark.sql(f"SELECT domain, cast(lang AS string) AS lang, cast(NULL AS string) AS source, cast(weight AS bigint) AS weight FROM VALUES {values} AS t(domain, lang, weight)")


#: DuckDB SQL of mix() with the production parameters; {docs} is the table.
SQL = r"""
WITH rows AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' THEN '' ELSE 'd' || (CAST(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS INT) % 4) END AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens, lang AS lang0, source AS source0
  FROM __DOCS__),
w(domain, lang, weight) AS (VALUES __WEIGHTS__),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM rows GROUP BY ALL),
total AS (SELECT CAST(sum(tokens) AS HUGEINT) * 3 // 5 AS budget FROM leaves),
""" + "".join(f"""
n{k} AS (SELECT {path}, {name} AS name, sum(tokens) * 2 AS cap, {weight} AS weight, {budget} AS budget FROM leaves {join} GROUP BY ALL),
o{k} AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
  sum(weight) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / weight, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM n{k}),
s{k} AS (SELECT *, cap * ws <= (budget - bef) * weight AS f FROM o{k}),
t{k} AS (SELECT *, sum(CASE WHEN f THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS taken, sum(CASE WHEN f THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open FROM s{k}),
g{k} AS (SELECT {path}, CASE WHEN f THEN cap ELSE least(cap, greatest(budget - taken, 0) * weight // greatest(open, 1)) END AS got FROM t{k}),
""" for k, path, name, parent, weight, budget, join in [
    (1, "domain", "domain", "1", "coalesce((SELECT max(weight) FROM w WHERE w.domain = leaves.domain AND w.lang IS NULL), 1)", "(SELECT budget FROM total)", ""),
    (2, "domain, lang", "lang", "domain", "coalesce((SELECT max(weight) FROM w WHERE w.domain = leaves.domain AND w.lang = leaves.lang), 1)", "(SELECT got FROM g1 WHERE g1.domain = leaves.domain)", ""),
    (3, "domain, lang, source", "source", "domain, lang", "1", "(SELECT got FROM g2 WHERE g2.domain = leaves.domain AND g2.lang = leaves.lang)", ""),
]) + r"""
plan AS (SELECT domain, lang, source, CAST(got // tokens AS BIGINT) AS fl, CAST(got % tokens AS BIGINT) AS rest FROM g3 JOIN leaves USING (domain, lang, source) WHERE got > 0),
keyed AS (SELECT *, CAST('0x' || substr(md5('7|' || fl || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM rows JOIN plan USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed),
picked AS (SELECT *, fl + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM run)
SELECT doc_id, lang0 AS lang, source0 AS source, domain, n_tokens, CAST(unnest(range(n)) AS INTEGER) AS epoch FROM picked WHERE n > 0
"""  # fmt: skip


def oracle_sql(docs: str = "documents") -> str:
    values = ", ".join(f"('{d}', {'NULL' if lang is None else repr(lang)}, {w})" for d, lang, w in WEIGHTS)
    return SQL.replace("__DOCS__", docs).replace("__WEIGHTS__", values)
