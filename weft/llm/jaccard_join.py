"""Grouped prefix join of documents by the Jaccard similarity of their word n-grams, and the classes that its links make.

Documents with equal sets are one node. Nodes with equal prefixes and size form a group: groups are indexed and filtered
against each other, then the pairs left are expanded to their members, whose whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._setjoin import SKETCH_BITS, Threshold, candidates, cold_tokens, components, folded, make_sets, may_match, prefixes, screen, signature, sketch, verify
from ._spark import Stored, pick, releasing, small, spare
from ._words import SPACED, U, chunks, mix, windows, words


#: Open tokens of a set that tell which bucket two sets meet in first; sets that share none of these meet in each bucket that both are in.
FIRST_TOKENS = 32
#: Buckets of a group's members are named by numbers from here on; those of tokens have 32 bits.
UNITS = 1 << 62
#: Rows of a bucket that are held against the whole bucket at once.
LOT_ROWS = 1 << 12


def _shingles(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in chunks(column):
        w = words(data, offsets, SPACED)
        yield first, end, *windows(w.hash, w.row_first, width)


def _unit(prefix: pa.Array, n: np.ndarray) -> np.ndarray:
    """Equal for equal prefixes and sizes."""
    at = prefix.offsets.to_numpy()
    sums = np.zeros(len(prefix.values) + 1, dtype=U)
    if len(prefix.values):
        np.cumsum(mix(prefix.values.to_numpy().astype(np.int64).view(U) ^ U(0x6C62272E07BB0142)), out=sums[1:])
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(n.astype(U))).view(np.int64)


def _sparse(values: pa.Array, where: np.ndarray) -> pa.Array:
    """values at the places that ``where`` marks, nulls elsewhere."""
    return values.take(pa.array(np.cumsum(where) - 1, mask=~where))


def document_sets(docs: DataFrame, width: int, t: Threshold, levels: np.ndarray, hot_rows: int) -> DataFrame:
    """doc_id, key (a hash of the text), n, node, bits, unit, cold, prefix, sig and q (folded from it) of each row; n is 0 and node null without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = shared.value, set()
        for b in batches:
            for first, end, tokens, bounds in _shingles(b.column(2), width):
                rows = end - first
                s = make_sets(tokens, np.repeat(np.arange(rows), np.diff(bounds)), rows, levels)
                some = s.n > 0
                fresh = np.zeros(rows, dtype=bool)  # a set's prefix is told once a task, as long as it remembers
                for k in np.flatnonzero(some).tolist():
                    if (x := int(s.node[k])) not in seen:
                        fresh[k] = True
                        seen.add(x)
                if len(seen) > 1_000_000:
                    seen.clear()
                prefix, sig = prefixes(s, fresh, t), signature(s, np.flatnonzero(fresh))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": b.column(0).slice(first, rows), "key": b.column(1).slice(first, rows), "n": pa.array(s.n.astype(np.int64)), "node": pa.array(s.node, mask=~some), "bits": s.bits,
                        "unit": _unit(prefix, s.n), "cold": cold_tokens(s, levels, hot_rows, t), "prefix": prefix, "sig": _sparse(sig, fresh), "q": _sparse(folded(sig), fresh),
                    }
                )

    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return docs.mapInArrow(releasing(run), f"doc_id {kind}, key long, n long, node long, bits long, unit long, cold int, prefix array<int>, sig binary, q array<long>")


def _near(a: str, b: str, c: str, t: Threshold) -> str:
    """SQL of the filter by folded bitmaps: of rows a.n, a.q and b.n, b.q; or, a being empty, of columns n and q ended by b and c."""
    n1, q1, n2, q2 = (f"n{b}", f"q{b}", f"n{c}", f"q{c}") if not a else (f"{a}n", f"{a}q", f"{b}n", f"{b}q")
    return f"{' + '.join(f'bit_count({q1}[{k}] ^ {q2}[{k}])' for k in range(4))} <= {n1} + {n2} - 2 * (({t.num} * ({n1} + {n2}) + {t.num + t.den - 1}) div {t.num + t.den})"


def _fits(a: str, b: str, t: Threshold) -> str:
    """SQL of the length, positional and 64-bit bitmap filters of rows a, b, each of one set."""
    least = f"(({t.num} * ({a}.n + {b}.n) + {t.num + t.den - 1}) div {t.num + t.den})"
    return (
        f"{t.num} * {a}.n <= {t.den} * {b}.n AND {t.num} * {b}.n <= {t.den} * {a}.n AND least({a}.n - {a}.i, {b}.n - {b}.i) >= {least}"
        f" AND bit_count({a}.bits ^ {b}.bits) <= {a}.n + {b}.n - 2 * {least}"
    )


class _Arrays:
    """Whole sets of the documents that pairs name, read from their texts when they're asked for."""

    def __init__(self, docs: DataFrame, known: DataFrame, width: int, store: Stored):
        self.docs, self.known, self.width, self.store, self.asked = docs, known, width, store, 0

    def of(self, pairs: DataFrame) -> DataFrame:
        """node and sorted tokens of the nodes of stored pairs(node, other); of rows that share a doc_id, several times."""
        self.asked += 1
        name = f"arrays-{self.asked}"
        nodes = self.store.write(pairs.select("node").union(pairs.select("other")).distinct(), f"{name}-nodes")
        ids = self.store.write(self.known.select("node", "doc_id").join(small(nodes), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), f"{name}-ids")
        texts = self.docs.join(small(ids), self.docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
        return self.store.write(self.read(texts).join(small(nodes), "node", "left_semi"), name)

    def read(self, docs: DataFrame) -> DataFrame:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
            for b in batches:
                for first, end, tokens, bounds in _shingles(b.column(0), width):
                    rows = end - first
                    s = make_sets(tokens, np.repeat(np.arange(rows), np.diff(bounds)), rows, none)
                    some = np.flatnonzero(s.n)
                    yield pa.RecordBatch.from_pydict({"node": s.node[some], "tokens": pa.array([s.tokens[s.bounds[k] : s.bounds[k + 1]].tobytes() for k in some], type=pa.binary())})

        return docs.select("text").mapInArrow(releasing(run), "node long, tokens binary")


def _classes(docs: DataFrame, width: int, threshold: Threshold, hot_rows: int, few: int, rounds: int) -> tuple[DataFrame, Stored]:
    """doc_id, key, n, node, comp (the class, null without words) and component_id of each row."""
    t, spark = threshold, docs.sparkSession
    docs = pick(docs, "doc_id", "text")
    store = Stored(spark, "jaccard")
    levels = sketch(docs.select("text"), lambda column: (x for _, _, x, _ in _shingles(column, width)))
    sets = store.write(document_sets(docs, width, t, levels, hot_rows), "sets")

    known = sets.where("node IS NOT NULL")
    # A group of one prefix and size is indexed once, under its least member, the head. Pairs of heads expand to pairs of
    # each member and the other's head; members meet their own head as well.
    groups = known.where("prefix IS NOT NULL").groupBy("unit").agg(
        F.min("node").alias("node"), (F.min("node") < F.max("node")).alias("several"), F.min_by("bits", "node").alias("bits"), *[F.first(c).alias(c) for c in ("n", "cold", "prefix")]
    )
    groups = groups.withColumn("q", F.lit(None).cast("array<bigint>"))  # most documents' would make the index twice as large
    groups = store.write(groups.withColumn("rank", F.col("node")), "groups")
    store.release()
    met, live = candidates(groups, t, store, draws=6)
    several = groups.where("several").select("unit", F.col("node").alias("head"))
    of = store.write(known.select("unit", "node", "n", "bits").join(several, "unit").distinct(), "members")
    own = of.select(F.col("head").alias("node"), F.col("node").alias("member"), F.col("bits").alias("own"))
    met = met.union(met.select(F.col("other").alias("node"), F.col("node").alias("other")))
    expanded = met.join(own, "node").select(F.col("member").alias("node"), "other")
    inside = of.where("node <> head").select("node", F.col("head").alias("other"))
    pairs = met.union(expanded).union(inside).select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other"))
    pairs = store.write(pairs.where("node <> other").distinct(), "all-pairs")
    live = live.join(own, "node", "left").select("token", F.coalesce("member", "node").alias("node"), "n", "i", F.coalesce("own", "bits").alias("bits"))
    inner = of.select(F.shiftrightunsigned("unit", 2).bitwiseOR(F.lit(UNITS)).alias("token"), "node", F.col("n").cast("int").alias("n"), F.lit(0).alias("i"), "bits")
    live = store.write(live.union(inner), "live-members")
    store.release()

    nodes = store.write(live.select("node").distinct(), "live-nodes")
    marks = store.write(known.where("sig IS NOT NULL").select("node", "n", "sig", "q").join(small(nodes), "node", "left_semi").dropDuplicates(["node"]), "marks")
    live = store.write(live.join(small(marks.select("node", "q"), 1 << 16), "node"), "live-marked")
    pairs = store.write(screen(pairs, marks, t), "screened")
    arrays = _Arrays(docs, known, width, store)
    links = verify(pairs, arrays.of(pairs), t, store, "links-0")
    labels = components(links, store, "labels-0")
    store.release()

    # Buckets whose sets aren't all of one class yet. Round by round, each set meets a few sets of other classes of its
    # buckets, drawn anew each time, so that a large class gathers those that belong to it without meeting pair by pair.
    step = 0
    while True:
        open_rows = live.join(small(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = open_rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / LOT_ROWS).cast("int").alias("lots")).where("lo < hi").select("token", "lots")
        open_rows = store.write(open_rows.join(mixed, "token"), f"open-{step}")
        by_comp = open_rows.groupBy("token", "comp").agg(F.count("*").alias("k"))
        rows, pairs_left = by_comp.groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk")).agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2)).first()
        if not rows or pairs_left <= few * rows or step == rounds:
            break
        step += 1
        drawn = open_rows.withColumn("lot", F.xxhash64("node", F.lit(step))).withColumn("urn", F.pmod("lot", F.lit(4)))
        heads = drawn.join(drawn.groupBy("token", "urn").agg(F.min("lot").alias("lot")), ["token", "urn", "lot"], "left_semi").withColumn("several", F.lit(False)).withColumns({f"q{k}": F.col("q")[k].bitwiseXOR(F.col("q")[k + 2]) for k in range(2)})
        met = open_rows.withColumn("several", F.lit(False)).withColumns({f"q{k}": F.col("q")[k].bitwiseXOR(F.col("q")[k + 2]) for k in range(2)}).alias("a").join(heads.alias("b"), F.expr(f"a.token = b.token AND a.comp <> b.comp AND {may_match('a', 'b', t)} AND {_near('a.', 'b.', '', t)}"))
        met = met.select("a.node", F.col("b.node").alias("other"), F.xxhash64("a.node", "b.node", F.lit(step)).alias("lot"))
        met = met.groupBy("node", F.pmod("lot", F.lit(4)).alias("urn")).agg(F.min_by("other", "lot").alias("other"))
        met = store.write(screen(met, marks, t), f"met-{step}")
        links = store.write(links.union(verify(met, arrays.of(met), t, store, f"links-{step}")), f"all-links-{step}")
        labels = components(links, store, f"labels-{step}")
        store.release()

    # What is left, whole: sets of different classes meet in the bucket of the first token that both have open, and in no
    # later one. Similar sets pass all filters there. A large bucket is dealt in lots.
    firsts = open_rows.groupBy("node").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("token") < UNITS, F.struct("i", F.col("token").cast("int").alias("token"))))), lambda x: x["token"]), 1, FIRST_TOKENS).alias("firsts"))
    rows = open_rows.join(firsts, "node")
    left, right = rows.withColumn("lot", F.expr("cast(pmod(xxhash64(node), lots) as int)")), rows.withColumn("lot", F.explode(F.expr("sequence(0, lots - 1)")))
    met = left.alias("a").join(right.alias("b"), F.expr(
        f"a.token = b.token AND a.lot = b.lot AND a.comp < b.comp AND {_fits('a', 'b', t)} AND {_near('a.', 'b.', '', t)} AND coalesce(get(array_intersect(a.firsts, b.firsts), 0), a.token) = a.token"
    ))
    more = met.select(F.least("a.node", "b.node").alias("node"), F.greatest("a.node", "b.node").alias("other")).distinct().join(small(pairs), ["node", "other"], "left_anti")
    more = store.write(screen(more, marks, t), "more")
    second = verify(more, arrays.of(more), t, store, "links-more")
    if second.limit(1).count():
        labels = components(store.write(links.union(second), "all-links"), store, "labels-more")

    names = known.groupBy("node").agg(F.min("doc_id").alias("least"))
    names = names.join(small(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = names.join(names.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "comp", "component_id")
    names = store.write(names, "names")
    store.release()
    found = sets.select("doc_id", "key", "n", "node").join(names, "node", "left")
    return found.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))), store


def jaccard_classes(docs: DataFrame, width: int = 4, threshold: Threshold = Threshold(85, 100), hot_rows: int = 1 << 17, few: int = 4, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs(doc_id, text).

    A document's set is its distinct ``width``-word shingles, lower-cased in A-Z (all its words if fewer); two rows link if
    their sets' Jaccard similarity reaches the threshold; component_id is the least doc_id among the rows that links reach.
    Null and wordless texts have empty sets, link with nothing and have component_id doc_id. Rows with a null doc_id link
    like others but name no component, unless all rows of it have none. Repeated rows are answered each. Columns beside these
    aren't read. Nothing is dropped: sets that share a frequent token are found through their other tokens or by a join.
    """
    found, _ = _classes(docs, width, threshold, hot_rows, few, rounds)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, width: int = 4, threshold: Threshold = Threshold(85, 100), hot_rows: int = 1 << 17, few: int = 4, rounds: int = 3) -> DataFrame:
    """The rows of docs, all columns, less those of which a row of the same class stays: of each class of
    jaccard_classes() one row, that of least doc_id, a null one last. Rows without words all stay."""
    found, store = _classes(docs, width, threshold, hot_rows, few, rounds)
    found = found.where("comp IS NOT NULL").select("comp", "doc_id", "key")
    rows = store.write(found.groupBy("comp", "doc_id", "key").agg(F.count("*").alias("k")), "rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    stay = rows.groupBy("comp").agg(F.min(first).alias("first")).select(F.col("comp").alias("c"), F.col("first.doc_id").alias("d"), F.col("first.key").alias("k0"))
    marked = rows.join(stay, rows["comp"] == stay["c"]).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k0")))
    key, other_id, other_key = spare(docs, "key", "other_id", "other_key")
    ends = [F.col("doc_id").alias(other_id), F.col("key").alias(other_key)]
    gone = store.write(marked.where("NOT stays").select(*ends), "gone")
    twice = store.write(marked.where("stays AND k > 1").select(*ends), "twice")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = lambda other: keyed["doc_id"].eqNullSafe(other[other_id]) & (keyed[key] == other[other_key])
    out = keyed.join(small(gone), same(gone), "left_anti")
    if twice.limit(1).count():  # rows that are there twice have one key
        again = keyed.join(small(twice), same(twice), "left_semi").dropDuplicates(["doc_id", key])
        out = out.join(small(twice), same(twice), "left_anti").unionByName(again)
    return out.drop(key)
