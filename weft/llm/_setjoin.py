"""An exact self-join of token sets by Jaccard similarity, in parts that the operators put together.

Rare tokens come first: a sketch of hashed counters, filled from all rows, orders them. Each distinct set is indexed under
the tokens of its prefix. Within a token's bucket, pairs pass that the length, positional and bitmap filters can't rule out.
The first stage emits no pairs but one partner, or a few, for each set, and the sets that have any; only what those
partners leave open is joined again, then with all pairs that pass the filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import releasing, small, small_batches
from ._words import U, distinct_sorted, mix

#: Counters of the sketch: a fixed size, whatever the input.
SKETCH_BITS = 22
_CHUNKS = 64


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity num / den or more, in whole numbers."""

    num: int
    den: int

    def overlap(self, sizes):
        """Least intersection of two sets whose sizes have this sum."""
        return -(-(self.num * sizes) // (self.num + self.den))

    def prefix(self, n):
        """Tokens of a set of n, of which any partner has one at least within its own prefix."""
        return n - (-(-(self.num * n) // self.den)) + 1


def sketch(texts: DataFrame, tokens: Callable[[pa.Array], Iterator[np.ndarray]]) -> np.ndarray:
    """Of each counter of hashed tokens, the logarithm of how often repeated tokens that fall on it occur in all rows, 0 to 255."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int32)
        waiting: list[np.ndarray] = []
        some = False

        def flush() -> None:
            # Tokens met once among some millions aren't counted: they would only blur the counters of others.
            if waiting:
                met = np.sort(np.concatenate(waiting))
                same = met[1:] == met[:-1]
                again = np.zeros(len(met), dtype=bool)
                again[1:] |= same
                again[:-1] |= same
                waiting.clear()
                # A task of over 2**31 occurrences of a token would have to be of some ten GB of text.
                total[:] += np.bincount((met[again] >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=size).astype(np.int32)

        for b in batches:
            for t in tokens(b.column(0)):
                waiting.append(t)
                some = some or len(t) > 0
                if sum(map(len, waiting)) > size // 2:
                    flush()
        flush()
        if some:
            # One byte each, and what is beyond it as (place, rest).
            low = np.minimum(total, 255).astype(np.uint8)
            for k, (x, y) in enumerate(zip(np.split(low, _CHUNKS), np.split(total, _CHUNKS), strict=True)):
                at = np.flatnonzero(y > 255)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], type=pa.int32()), "counts": pa.array([x.tobytes()], type=pa.binary()), "at": pa.array([at]), "rest": pa.array([(y[at] - 255).astype(np.int64)])})

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(size // _CHUNKS, dtype=np.int64)
        for x, at, rest in zip(rows.column("counts"), rows.column("at"), rows.column("rest"), strict=True):
            total += np.frombuffer(x.as_buffer(), dtype=np.uint8)
            np.add.at(total, at.values.to_numpy(), rest.values.to_numpy())
        level = np.minimum(255, np.floor(8 * np.log2(1 + total))).astype(np.uint8)
        return pa.table({"chunk": pa.array([rows.column("chunk")[0].as_py()], type=pa.int32()), "levels": pa.array([level.tobytes()], type=pa.binary())})

    with small_batches(texts.sparkSession):
        parts = texts.mapInArrow(releasing(count), "chunk int, counts binary, at array<long>, rest array<long>").groupBy("chunk").applyInArrow(add, "chunk int, levels binary").collect()
    levels = np.zeros(size, dtype=np.uint8)
    for r in parts:
        levels[r.chunk * (size // _CHUNKS) : (r.chunk + 1) * (size // _CHUNKS)] = np.frombuffer(r.levels, dtype=np.uint8)
    return levels


@dataclass
class Sets:
    """Distinct sets of a chunk's groups: sizes, ids (equal for equal sets), bitmaps, and prefixes of the rarest tokens."""

    tokens: np.ndarray
    bounds: np.ndarray
    n: np.ndarray
    node: np.ndarray
    bits: np.ndarray


def make_sets(tokens: np.ndarray, group: np.ndarray, n_groups: int, levels: np.ndarray) -> Sets:
    keys, bounds = distinct_sorted(tokens, group, n_groups, levels[(tokens >> U(64 - SKETCH_BITS)).astype(np.int64)])
    n = np.diff(bounds)
    sums = np.zeros(len(keys) + 1, dtype=U)
    np.cumsum(mix(keys ^ U(0xA24BAED4963EE407)), out=sums[1:])
    node = mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(U)).view(np.int64)
    # Parity bitmap: bit k is the parity of the number of tokens that fall on k.
    bit = np.zeros(len(keys) + 1, dtype=U)
    np.bitwise_xor.accumulate(np.left_shift(U(1), mix(keys) >> U(58)), out=bit[1:])
    return Sets(keys, bounds, n, node, (bit[bounds[1:]] ^ bit[bounds[:-1]]).view(np.int64))


def prefixes(s: Sets, which: np.ndarray, t: Threshold) -> pa.Array:
    """Prefixes of the sets ``which`` marks, 32 bits a token, which only chooses a bucket; null of the others."""
    size = np.where(which, t.prefix(s.n), 0)
    at = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(s.bounds[:-1], size)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((s.tokens[take] >> U(32)).astype(np.uint32).view(np.int32)), mask=pa.array(~which))


def cold_tokens(s: Sets, levels: np.ndarray, hot_rows: int, t: Threshold) -> np.ndarray:
    """Of each set, how many tokens of its prefix occur less than ``hot_rows`` times; they come first in the prefix."""
    hot = levels[(s.tokens >> U(64 - SKETCH_BITS)).astype(np.int64)] >= min(255, int(8 * np.log2(1 + hot_rows)))
    sums = np.concatenate([[0], np.cumsum(~hot)])
    return np.minimum(sums[s.bounds[1:]] - sums[s.bounds[:-1]], t.prefix(s.n)).astype(np.int32)


#: Sets of so many tokens have bitmaps of 128 bits besides those of 64.
WIDE = 96
_WIDE_COLUMNS = ["q0", "q1"]
#: Partitions of the index at least, and rows of it for each of them.
INDEX_PARTITIONS, INDEX_ROWS = 64, 250_000


def _may_match(a: np.ndarray, b: np.ndarray, n, i, bits, wide, several, t: Threshold) -> np.ndarray:
    """Whether the pairs of rows a, b can be similar. several: a row stands for sets with other bitmaps as well."""
    na, nb = n[a], n[b]
    least = t.overlap(na + nb)
    ok = np.flatnonzero(np.minimum(na - i[a], nb - i[b]) >= least)
    a, b, room, out = a[ok], b[ok], (na + nb - 2 * least)[ok], np.zeros(len(a), dtype=bool)
    free = several[a] | several[b]
    fits = free | (np.bitwise_count((bits[a] ^ bits[b]).view(U)) <= room)
    ok, a, b, room, free = ok[fits], a[fits], b[fits], room[fits], free[fits]
    large = np.flatnonzero(~free & (n[a] >= WIDE) & (n[b] >= WIDE))
    far = sum(np.bitwise_count((q[a[large]] ^ q[b[large]]).view(U)).astype(np.int64) for q in wide) > room[large]
    out[ok] = True
    out[ok[large[far]]] = False
    return out


def may_match(a: str, b: str, t: Threshold) -> str:
    """The same filters in SQL, and the length filter, of rows with columns n, i, bits, several, q0, q1."""
    least = f"(({t.num} * ({a}.n + {b}.n) + {t.num + t.den - 1}) div {t.num + t.den})"
    return (
        f"{t.num} * {a}.n <= {t.den} * {b}.n AND {t.num} * {b}.n <= {t.den} * {a}.n AND least({a}.n - {a}.i, {b}.n - {b}.i) >= {least}"
        f" AND ({a}.several OR {b}.several OR bit_count({a}.bits ^ {b}.bits) <= {a}.n + {b}.n - 2 * {least}"
        f" AND ({a}.n < {WIDE} OR {b}.n < {WIDE} OR {' + '.join(f'bit_count({a}.{q} ^ {b}.{q})' for q in _WIDE_COLUMNS)} <= {a}.n + {b}.n - 2 * {least}))"
    )


def bucket_pass(index: DataFrame, t: Threshold, merge: bool = False, draws: int = 0, n_rows: int = 0, pairs_at_once: int = 1 << 18) -> DataFrame:
    """index of n_rows rows (token, node, rank, n, i, bits, several, q0, q1): the prefix tokens of distinct sets. Rows of two kinds: (node, other, rank, i: the draw or -1) with
    a set's passing partner of lowest rank in this task's buckets, if that's below its own; and, other null, the index rows
    that have a partner. draws: for each set as many partners more, drawn by hashes of the pairs.
    """
    spark = index.sparkSession
    rows = index.repartition(max(INDEX_PARTITIONS, -(-n_rows // INDEX_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))), "token").select("token", "node", "rank", "n", "i", "bits", "several", *_WIDE_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        got.clear()
        token, node, rank, n, i, bits, several, *wide = (table.column(k).to_numpy() for k in range(9))
        del table
        by = np.lexsort((rank, node, token)) if merge else np.argsort(token)
        if merge:  # of a set told by several tasks, the row of lowest rank
            t0, n0 = token[by], node[by]
            new = np.ones(len(by), dtype=bool)
            new[1:] = (t0[1:] != t0[:-1]) | (n0[1:] != n0[:-1])
            by = by[new]
        sorted_token = token[by]
        same = sorted_token[1:] == sorted_token[:-1]
        many = np.zeros(len(by), dtype=bool)
        many[1:] |= same
        many[:-1] |= same
        by = by[many]
        if not len(by):
            return
        by = by[np.lexsort((n[by], token[by]))]
        token, node, rank, n, i, bits, several = (x[by] for x in (token, node, rank, n.astype(np.int64), i.astype(np.int64), bits, several))
        wide = [q[by] for q in wide]
        new = np.ones(len(token), dtype=bool)
        new[1:] = token[1:] != token[:-1]
        bucket = np.cumsum(new)
        # Sorted by size within a bucket, partners that aren't too long follow a row without a gap.
        end = np.searchsorted((bucket << 34) + n, (bucket << 34) + n * t.den // t.num, "right")
        count = end - np.arange(len(n)) - 1
        order = np.argsort(rank, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        best = place.copy()
        drawn = [np.full(len(order), ~U(0)) for _ in range(draws)]
        live = np.zeros(len(n), dtype=bool)
        total = np.concatenate([[0], np.cumsum(count)])
        row = 0
        while row < len(n):
            stop = max(row + 1, int(np.searchsorted(total, total[row] + pairs_at_once, "right")) - 1)
            c = count[row:stop]
            a = np.repeat(np.arange(row, stop), c)
            b = np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + a + 1
            ok = _may_match(a, b, n, i, bits, wide, several, t)
            a, b = a[ok], b[ok]
            live[a] = live[b] = True
            np.minimum.at(best, a, place[b])
            np.minimum.at(best, b, place[a])
            for k, least in enumerate(drawn):
                # The hash of the pair above the partner's place, which thus comes along with the least hash.
                lot = mix((node[a] + node[b]).view(U) ^ U(0x5851F42D4C957F2D * (2 * k + 1) & (1 << 64) - 1)) & ~U((1 << 28) - 1)
                np.minimum.at(least, a, lot | place[b].astype(U))
                np.minimum.at(least, b, lot | place[a].astype(U))
            row = stop
        linked = np.flatnonzero(live)
        if not len(linked):
            return
        yield pa.RecordBatch.from_pydict({"node": node[linked], "other": pa.nulls(len(linked), pa.int64()), "token": token[linked], "rank": rank[linked], "n": n[linked].astype(np.int32), "i": i[linked].astype(np.int32), "bits": bits[linked], "several": several[linked], **{c: q[linked] for c, q in zip(_WIDE_COLUMNS, wide, strict=True)}})
        chosen = [(np.flatnonzero(best < place), best, -1)]
        chosen += [(np.flatnonzero(least != ~U(0)), (least & U((1 << 28) - 1)).astype(np.int64), k) for k, least in enumerate(drawn)]
        for first, partner, k in chosen:
            by = rank[order[partner[first]]] if k < 0 else (drawn[k][first] >> U(28)).astype(np.int64)
            pick = np.lexsort((by, node[first]))
            first, by = first[pick], by[pick]
            once = np.ones(len(first), dtype=bool)
            once[1:] = node[first[1:]] != node[first[:-1]]
            first, by = first[once], by[once]
            if m := len(first):
                none, zero = pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())
                yield pa.RecordBatch.from_pydict({"node": node[first], "other": node[order[partner[first]]], "token": zero, "rank": by, "n": zero, "i": pa.array(np.full(m, k, np.int32)), "bits": none, "several": pa.nulls(m, pa.bool_()), **{c: none for c in _WIDE_COLUMNS}})

    return rows.mapInArrow(releasing(run), "node long, other long, token int, rank long, n int, i int, bits long, several boolean, q0 long, q1 long")


def candidates(nodes: DataFrame, t: Threshold, store, merge: bool = False, draws: int = 0) -> tuple[DataFrame, DataFrame]:
    """From nodes(node, rank, n, bits, several, prefix, cold, q), the distinct sets: pairs(node, other) of each set and its partner of
    lowest rank, if that's below its own; and the index rows that may have partners. Buckets of frequent tokens, of which
    a task can't be sure to hold one, are joined with their row of lowest rank instead; all their rows may have partners. merge: nodes may hold a set several
    times, with different ranks, of which the lowest counts."""
    # Sets so small that only equal ones are similar have no partner.
    nodes = nodes.where(f"size(prefix) > 0 AND n * {t.den - t.num} >= {t.num}")
    columns = ["token", "node", "rank", "n", "i", "bits", "several", *_WIDE_COLUMNS]
    nodes = nodes.withColumns({c: F.coalesce(F.col("q")[k], F.lit(0)) for k, c in enumerate(_WIDE_COLUMNS)})
    index = lambda rows: rows.select("node", "rank", F.col("n").cast("int").alias("n"), "bits", "several", "cold", *_WIDE_COLUMNS, F.posexplode("prefix").alias("i", "token"))
    n_rows = nodes.agg(F.sum(F.least("cold", F.size("prefix")).cast("long"))).first()[0] or 0
    passed = store.write(bucket_pass(index(nodes).where("i < cold").select(*columns), t, merge, draws, n_rows), "passed")
    store.release()
    hot = index(nodes.where("cold < size(prefix)")).where("i >= cold").select(*columns)
    if merge:
        hot = hot.groupBy(*[c for c in columns if c != "rank"]).agg(F.min("rank").alias("rank")).select(*columns)
    hot = store.write(hot, "hot")
    least = hot.groupBy("token").agg(F.min("rank").alias("rank"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    heads = hot.join(least, ["token", "rank"], "left_semi")
    starred = hot.alias("a").join(heads.alias("b"), F.expr(f"a.token = b.token AND a.rank > b.rank AND {may_match('a', 'b', t)}")).select("a.node", F.col("b.node").alias("other"), "b.rank")
    found = passed.where("other IS NOT NULL").select("node", "other", "rank", "i").union(starred.withColumn("i", F.lit(-1)))
    pairs = found.groupBy("node", "i").agg(F.min_by("other", "rank").alias("other")).select("node", "other")
    live = passed.where("other IS NULL").select(*columns).union(hot)
    return store.write(pairs, "pairs"), store.write(live, "live")


def signature(s: Sets, which: np.ndarray) -> pa.Array:
    """Parity bitmaps of 1024 bits of the sets ``which`` names."""
    out = np.zeros((len(which), 1024), dtype=np.uint8)
    slot = (mix(s.tokens ^ U(0x3C79AC492BA7B653)) >> U(54)).astype(np.int64)
    for row, k in enumerate(which):
        out[row] = np.bincount(slot[s.bounds[k] : s.bounds[k + 1]], minlength=1024) & 1
    packed = np.packbits(out, axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(128), len(which), [None, pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())


def folded(sig: pa.Array, longs: int = 4) -> pa.Array:
    """The smaller parity bitmaps that signatures hold, of so many long numbers each."""
    words = np.frombuffer(b"".join(sig.to_pylist()), dtype=U).reshape(-1, 16 // longs, longs)
    return pa.FixedSizeListArray.from_arrays(pa.array(np.bitwise_xor.reduce(words, axis=1).ravel().view(np.int64)), longs).cast(pa.list_(pa.int64()))


def wide_bitmaps(s: Sets, which: np.ndarray) -> pa.Array:
    """Parity bitmaps of 128 bits, two long numbers, of the sets ``which`` marks that are large; null of the others."""
    which = which & (s.n >= WIDE)
    sig = folded(signature(s, np.flatnonzero(which)), 2)
    return sig.take(pa.array(np.cumsum(which) - 1, mask=~which))


def screen(pairs: DataFrame, marks: DataFrame, t: Threshold) -> DataFrame:
    """The pairs(node, other) that the 1024-bit signatures in marks(node, n, sig) can't rule out."""
    marks = small(marks, 1 << 16)
    a = marks.select("node", F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = marks.select(F.col("node").alias("other"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    both = pairs.select("node", "other").join(a, "node").join(b, "other").select("node", "other", "n_a", "n_b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                na, nb = (x.column(k).to_numpy() for k in (2, 3))
                a, b = (np.frombuffer(b"".join(x.column(k).to_pylist()), dtype=U).reshape(-1, 16) for k in (4, 5))
                keep = np.bitwise_count(a ^ b).sum(axis=1) <= na + nb - 2 * t.overlap(na + nb)
                yield x.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(releasing(run), "node long, other long")


def verify(pairs: DataFrame, arrays: DataFrame, t: Threshold, store, name: str) -> DataFrame:
    """The pairs(node, other), distinct, whose sets in arrays(node, tokens binary: sorted 64-bit values) are similar enough."""
    pairs = store.write(pairs.select("node", "other").distinct(), f"{name}-asked")
    others = store.write(pairs.select("other").distinct(), f"{name}-others")
    own = arrays.select("node", F.col("tokens").alias("own")).join(small(pairs), "node")
    its = arrays.select(F.col("node").alias("other"), F.col("tokens").alias("its")).join(small(others), "other", "left_semi")
    both = own.join(its, "other").select("node", "other", "own", "its")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(t.den * common >= t.num * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return store.write(both.mapInArrow(releasing(run), "node long, other long"), name)


#: Links that one task joins into classes at most; beyond it they are joined by rounds over all executors.
LINKS_IN_A_TASK = 1 << 18


def components(links: DataFrame, store, name: str, in_a_task: int = LINKS_IN_A_TASK) -> DataFrame:
    """(node, comp): the least node reachable, for each node that has a link, of stored links(node, other)."""
    if links.limit(in_a_task + 1).count() <= in_a_task:
        return store.write(links.select("node", "other").coalesce(1).mapInArrow(_union_find, "node long, comp long"), name)
    return _spread_components(links, store, name)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = k = root[up]
        return k

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, type=pa.int64()), "comp": pa.array([find(k) for k in nodes], type=pa.int64())})


def _spread_components(links: DataFrame, store, name: str) -> DataFrame:
    """The same by rounds of least neighbours and pointer jumping; each round is a stored table, and the rounds double the
    distance that a least node travels."""
    both = store.write(links.select("node", "other").union(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), f"{name}-edges")
    labels = store.write(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        jumped = lower.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp", "left").select("node", F.least("comp", F.coalesce("far", "comp")).alias("comp"), "was")
        stored = store.write(jumped, f"{name}-{step}")
        changed = stored.where("comp <> was").limit(1).count()
        store.drop(f"{name}-{step - 1}")
        labels = stored.select("node", "comp")
        if not changed:
            return labels
