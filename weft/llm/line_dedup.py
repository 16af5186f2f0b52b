"""Line dedup by an exact set-similarity join: a line goes if an earlier line of any document has nearly the same words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._setjoin import SKETCH_BITS, Threshold, candidates, cold_tokens, make_sets, may_match, prefixes, sketch, verify, wide_bitmaps
from ._spark import Stored, pick, releasing, small
from ._words import SPACED, chunks, words


def _lines(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, the words' lines numbered through the chunk, first line of each row and their number)."""
    for first, end, data, offsets in chunks(column):
        w = words(data, offsets, SPACED)
        breaks = np.flatnonzero(data == 10)
        row_line = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
        row = np.repeat(np.arange(end - first), np.diff(w.row_first))
        yield first, end, w.hash, np.searchsorted(breaks, w.start) + row, row_line


#: Lines that a task holds before it tells their distinct sets.
LINES_HELD = 1 << 17


def line_sets(docs: DataFrame, t: Threshold, room: int, levels: np.ndarray, hot_rows: int) -> DataFrame:
    """Rows of two kinds from docs(place, key, text). rank, key and node of each line with a word, prefix null; and of each
    distinct set that may have partners, once a task as far as it remembers, node, its lowest rank there, n, bits, cold, prefix and q."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def tell(held: list[tuple]) -> pa.RecordBatch:
        node, rank, n, bits, cold = (np.concatenate([h[k] for h in held]) for k in range(5))
        prefix, q = (pa.concat_arrays([h[k] for h in held]) for k in (5, 6))
        by = np.lexsort((rank, node))
        new = np.ones(len(by), dtype=bool)
        new[1:] = node[by[1:]] != node[by[:-1]]
        by = by[new]
        return pa.RecordBatch.from_pydict({"rank": rank[by], "key": pa.nulls(len(by), pa.int64()), "node": node[by], "n": n[by], "bits": bits[by], "cold": cold[by], "prefix": prefix.take(pa.array(by)), "q": q.take(pa.array(by))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held, n_held = shared.value, [], 0
        for b in batches:
            place, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            for first, end, hashes, line, row_line in _lines(b.column(2)):
                s = make_sets(hashes, line, int(row_line[-1]), levels)
                row = np.repeat(np.arange(first, end), np.diff(row_line))
                rank = place[row] * room + np.arange(len(s.n)) - row_line[row - first]
                some = np.flatnonzero(s.n)
                m = len(some)
                yield pa.RecordBatch.from_pydict(
                    {
                        "rank": rank[some], "key": key[row[some]], "node": s.node[some], "n": pa.nulls(m, pa.int32()), "bits": pa.nulls(m, pa.int64()),
                        "cold": pa.nulls(m, pa.int32()), "prefix": pa.nulls(m, pa.list_(pa.int32())), "q": pa.nulls(m, pa.list_(pa.int64())),
                    }
                )
                # Of a set's copies in the chunk, the lowest rank.
                large = np.flatnonzero(s.n * (t.den - t.num) >= t.num)
                large = large[np.lexsort((rank[large], s.node[large]))]
                new = np.ones(len(large), dtype=bool)
                new[1:] = s.node[large[1:]] != s.node[large[:-1]]
                large = large[new]
                fresh = np.zeros(len(s.n), dtype=bool)
                fresh[large] = True
                large = np.flatnonzero(fresh)
                prefix = prefixes(s, fresh, t).take(pa.array(large))
                held.append((s.node[large], rank[large], s.n[large].astype(np.int32), s.bits[large], cold_tokens(s, levels, hot_rows, t)[large], prefix, wide_bitmaps(s, fresh).take(pa.array(large))))
                n_held += len(large)
                if n_held >= LINES_HELD:
                    yield tell(held)
                    held, n_held = [], 0
        if held:
            yield tell(held)

    return docs.mapInArrow(releasing(run), "rank long, key long, node long, n int, bits long, cold int, prefix array<int>, q array<long>")


def _line_arrays(docs: DataFrame) -> DataFrame:
    """node and sorted words of the lines named in docs(text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
        for b in batches:
            picked: list[str] = []
            for text, wanted in zip(b.column(0), b.column(1), strict=True):
                own = text.as_py().split("\n")
                picked += [own[k] for k in wanted.as_py() if k < len(own)]
            for first, end, data, offsets in chunks(pa.array(picked, type=pa.string())):
                w = words(data, offsets, SPACED)
                s = make_sets(w.hash, np.repeat(np.arange(end - first), np.diff(w.row_first)), end - first, none)
                some = np.flatnonzero(s.n)
                yield pa.RecordBatch.from_pydict({"node": s.node[some], "tokens": pa.array([s.tokens[s.bounds[k] : s.bounds[k + 1]].tobytes() for k in some], type=pa.binary())})

    return docs.mapInArrow(releasing(run), "node long, tokens binary")


def _places(docs: DataFrame, store: Stored) -> tuple[DataFrame, int, DataFrame | None, int]:
    """docs with ``place``, a whole number that orders rows by doc_id, nulls first; the number of lines that fits beside it; and
    what gives doc_id back: a table of places, or else the doc_id of place 0, which is null's, were it one."""
    lo, hi, lines = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))))).first()
    room = 1 << max(1, int((lines or 0) + 1).bit_length())
    if isinstance(docs.schema["doc_id"].dataType, IntegralType) and (lo is None or (hi - lo + 2) * room < 1 << 62):
        return docs.withColumn("place", F.coalesce(F.col("doc_id") - F.lit(lo or 0) + 1, F.lit(0)).cast("long")), room, None, (lo or 0) - 1
    # Ranges of ids are sorted by themselves and numbered through, so that no task sees all of them.
    ids = docs.select(F.col("doc_id").alias("id")).distinct().repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    ids = store.write(ids.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ids")
    sizes = ids.groupBy("part").agg(F.count("*").alias("k"), F.min("at").alias("lo"))
    shift = sizes.select("part", (F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("lo")).alias("shift"))
    ranked = store.write(ids.join(shift, "part").select("id", (F.col("at") + F.col("shift")).cast("long").alias("place")), "places")
    return docs.join(ranked, docs["doc_id"].eqNullSafe(ranked["id"])).drop("id"), room, ranked, 0


def later_lines(docs: DataFrame, threshold: Threshold = Threshold(4, 5), hot_rows: int = 1 << 17) -> DataFrame:
    """(doc_id, key, gone: line numbers) of the rows of docs(doc_id, text, key) that lose lines."""
    t, spark = threshold, docs.sparkSession
    store = Stored(spark, "lines")
    docs, room, ranked, shift = _places(docs, store)
    levels = sketch(docs.select("text"), lambda column: (h for _, _, h, _, _ in _lines(column)))
    told = store.write(line_sets(docs.select("place", "key", "text"), t, room, levels, hot_rows), "lines")
    lines, sets = told.where("prefix IS NULL").select("rank", "key", "node"), told.where("prefix IS NOT NULL").select("node", "rank", "n", "bits", "cold", "prefix", "q")
    pairs, live = candidates(sets.withColumn("several", F.lit(False)), t, store, merge=True)

    needed = store.write(live.select("node", "rank").distinct(), "needed")
    wanted = needed.select(F.expr(f"rank div {room}").alias("place"), F.expr(f"cast(rank % {room} as int)").alias("line")).groupBy("place").agg(F.collect_set("line").alias("wanted"))
    wanted = store.write(wanted, "wanted")
    arrays = _line_arrays(docs.where(F.col("text").isNotNull()).join(small(wanted), "place").select("text", "wanted"))
    arrays = store.write(arrays, "arrays")
    store.release()
    first = verify(pairs, arrays, t, store, "verified").select("node").distinct()

    # Sets whose first partner wasn't similar after all, against all earlier ones of their buckets.
    open_rows = live.join(first, "node", "left_anti")
    more = open_rows.alias("a").join(live.alias("b"), F.expr(f"a.token = b.token AND a.rank > b.rank AND {may_match('a', 'b', t)}"))
    more = more.select("a.node", F.col("b.node").alias("other")).distinct().join(pairs, ["node", "other"], "left_anti")
    similar = store.write(first.union(verify(more, arrays, t, store, "verified-more").select("node")).distinct(), "similar")

    marks = lines.groupBy("node").agg(F.min("rank").alias("least")).join(similar.withColumn("similar", F.lit(True)), "node", "left")
    gone = lines.join(marks, "node").where(F.col("similar") | (F.col("rank") > F.col("least")))
    gone = gone.groupBy(F.expr(f"rank div {room}").alias("place"), "key").agg(F.collect_set(F.expr(f"cast(rank % {room} as int)")).alias("gone"))
    if ranked is None:
        gone = gone.select(F.when(F.col("place") > 0, F.col("place") + shift).alias("doc_id"), "key", "gone")
    else:
        gone = gone.join(ranked, "place").select(F.col("id").alias("doc_id"), "key", "gone")
    gone = store.write(gone, "gone")
    store.release()
    return gone


def dedup_lines(docs: DataFrame, threshold: Threshold = Threshold(4, 5), counts: bool = False, hot_rows: int = 1 << 17) -> DataFrame:
    """docs, all columns and rows, with later lines taken out of ``text``; with ``counts``, n_lines and n_removed as well.

    Lines end at \\n; a line's set is its distinct words, lower-cased in A-Z. A line of one word or more goes if the Jaccard
    similarity with a line that stands earlier, in order of doc_id and of lines within it, reaches the threshold, whether
    or not that line stays itself. Lines without words stay. A null text stays null; rows with a null doc_id come first. Rows that
    share a doc_id stand at the same place, so that their lines of equal number aren't later than each other. Clashing names
    of other columns don't matter; with ``counts``, n_lines and n_removed take the place of columns of these names. An empty table
    stays empty.
    """
    if counts:
        docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    plain = pick(docs, "doc_id", "text").withColumn("key", F.xxhash64("text"))
    gone = later_lines(plain, threshold, hot_rows)
    text_at, id_at, names = docs.columns.index("text"), docs.columns.index("doc_id"), docs.columns
    source = docs.toDF(*[f"c{k}" for k in range(len(names))])
    both = source.join(small(gone), source[f"c{id_at}"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(source[f"c{text_at}"]) == gone["key"]), "left").drop("doc_id", "key")
    schema = docs.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + (", n_lines long, n_removed long" if counts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_removed = [], [], []
            for text, lost in zip(b.column(text_at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                own = [] if text is None else text.split("\n")
                n_lines.append(len(own))
                n_removed.append(len(lost or ()))
                if lost:
                    lost = set(lost)
                    text = "\n".join(x for k, x in enumerate(own) if k not in lost)
                texts.append(text)
            columns = [pa.array(texts, type=pa.string()) if k == text_at else b.column(k) for k in range(len(names))]
            if counts:
                columns += [pa.array(n_lines, type=pa.int64()), pa.array(n_removed, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_lines", "n_removed"] if counts else names)

    return both.mapInArrow(releasing(run), ddl)
