"""Benchmark decontamination by suffix arrays over the training texts that every suffix of the benchmark is searched in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Stored, pick, releasing
from ._words import ALNUM, chunks, words

#: Suffixes of a shard at most, but for the rest of the chunk that reaches it.
SHARD_SUFFIXES = 1 << 18
#: Windows searched at once, whose keys are made for the search alone.
WINDOWS_AT_ONCE = 1 << 16
#: Blocks of the benchmark that a scan of the documents holds; more of them take more scans.
BLOCKS_HELD = 4


@dataclass
class Block:
    """Some of the benchmark's items: their words' ranks, and each distinct window, in the order of its words, with the items that hold it."""

    items: list[str | None]
    vocabulary: np.ndarray  # sorted hashes; a word's rank is its place + 1, words not in here have rank 0
    ranks: np.ndarray  # of the items' words, one after the other
    pairs: np.ndarray  # sorted (rank of a word, rank of the next or 0 for one-word items) that windows begin with
    start: np.ndarray  # of each distinct window: the first of its words in ranks
    width: np.ndarray
    holder_at: np.ndarray  # of window w: holders[holder_at[w]:holder_at[w + 1]]
    holders: np.ndarray
    where: np.ndarray  # word at which the window begins in the holder's text


def _keys(ranks: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, fill: int) -> np.ndarray:
    """The words ``start``, start + 1, ... as byte strings that sort as the words' ranks do; beyond ``size`` words, ``fill``."""
    table = np.full((len(start), width), fill, dtype=">u4")
    for k in range(width):
        has = k < size
        table[has, k] = ranks[start[has] + k]
    return table.view(f"S{4 * width}").ravel()


def block(ids: list[str | None], texts: list[str], width: int) -> Block:
    column = pa.array(texts, type=pa.string())
    hashes, rows = [], []
    for first, _, data, offsets in chunks(column):
        w = words(data, offsets, ALNUM)
        hashes.append(w.hash)
        rows.append(np.repeat(np.arange(len(offsets) - 1) + first, np.diff(w.row_first)))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    vocabulary = np.unique(h)
    ranks = (np.searchsorted(vocabulary, h) + 1).astype(np.int32)
    bounds = np.searchsorted(row, np.arange(len(ids) + 1))
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    holder = np.repeat(np.arange(len(ids)), count)
    where = np.arange(len(holder)) - np.repeat(np.cumsum(count) - count, count)
    start, size = bounds[:-1][holder] + where, np.minimum(n[holder], width)
    key = _keys(ranks, start, size, width, 0)
    order = np.lexsort((where, holder, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    at = np.flatnonzero(new)
    start, size = start[order[at]], size[order[at]]
    second = np.where(size > 1, np.append(ranks, 0)[start + 1], 0) if len(start) else start
    pairs = np.unique((ranks[start].astype(np.int64) << 32) + second)
    small = lambda x: x.astype(np.int32)
    return Block(ids, vocabulary, ranks, pairs, small(start), small(size), np.append(at, len(order)), small(holder[order]), small(where[order]))


class Shard:
    """Training suffixes that may match, waiting to be sorted, and the documents they're of."""

    def __init__(self, b: Block, width: int):
        self.block, self.width = b, width
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.suffixes = 0

    def add(self, hashes: np.ndarray, row_first: np.ndarray, first_doc: int) -> None:
        """Adds the suffixes of a chunk's documents that begin like some window."""
        b, n = self.block, len(hashes)
        if not n or not len(b.start):
            return
        rank = np.searchsorted(b.vocabulary, hashes)
        rank = np.where(b.vocabulary[np.minimum(rank, len(b.vocabulary) - 1)] == hashes, rank + 1, 0)
        ends = np.zeros(n + 1, dtype=bool)  # a document ends before this word
        ends[row_first] = True
        known = np.flatnonzero(rank)
        after = np.where(ends[known + 1], 0, np.append(rank, 0)[known + 1])
        head = rank[known] << 32
        is_in = lambda x: b.pairs[np.minimum(np.searchsorted(b.pairs, x), len(b.pairs) - 1)] == x
        known = known[is_in(head + after) | is_in(head)]
        if not len(known):
            return
        doc = np.searchsorted(row_first, known, "right") - 1
        self.keys.append(_keys(rank, known, row_first[doc + 1] - known, self.width, 0))
        self.at.append(known - row_first[doc])
        self.doc.append(doc + first_doc)
        self.suffixes += len(known)

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word, window) of each window's occurrences, found by two binary searches for each window; the shard is empty then."""
        none = np.zeros(0, dtype=np.int64)
        if not self.keys:
            return none, none, none
        keys, at, doc = np.concatenate(self.keys), np.concatenate(self.at), np.concatenate(self.doc)
        self.keys, self.at, self.doc, self.suffixes = [], [], [], 0
        array = np.argsort(keys, kind="stable")
        keys = keys[array]
        b, out = self.block, []
        for first in range(0, len(b.start), WINDOWS_AT_ONCE):
            start, size = b.start[first : first + WINDOWS_AT_ONCE], b.width[first : first + WINDOWS_AT_ONCE]
            lo = np.searchsorted(keys, _keys(b.ranks, start, size, self.width, 0), "left")
            n = np.searchsorted(keys, _keys(b.ranks, start, size, self.width, (1 << 32) - 1), "right") - lo
            window = np.repeat(np.arange(len(n)), n)
            found = array[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + lo[window]]
            out.append((doc[found], at[found], window + first))
        return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _covered(doc: np.ndarray, at: np.ndarray, size: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that lie in one at least of the spans."""
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + size)[order]
    # Ends so far within the document: shifted by document, so that one running maximum serves all.
    shift = doc * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + shift) - shift
    before = np.concatenate([[0], np.where(doc[1:] == doc[:-1], reach[:-1], 0)]) if len(doc) else reach
    return np.bincount(doc, weights=np.maximum(0, end - np.maximum(at, before)), minlength=n_docs).astype(np.int64)


def _longest(doc: np.ndarray, at: np.ndarray, window: np.ndarray, b: Block) -> dict[int, list[dict]]:
    """Maximal verbatim matches by document: windows that follow one another in an item and in the document are one match."""
    if not len(window):
        return {}
    n = b.holder_at[window + 1] - b.holder_at[window]
    one = np.repeat(np.arange(len(window)), n)
    k = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + b.holder_at[window][one]
    doc, at, size, item, where = doc[one], at[one], b.width[window][one], b.holders[k], b.where[k]
    order = np.lexsort((at, at - where, item, doc))
    doc, at, size, item, where = doc[order], at[order], size[order], item[order], where[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - where[1:] != at[:-1] - where[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    out: dict[int, list[dict]] = {}
    for f, e in zip(first.tolist(), last.tolist(), strict=True):
        out.setdefault(int(doc[f]), []).append({"item_id": b.items[item[f]], "item_word": int(where[f]), "doc_word": int(at[f]), "n_words": int(at[e] + size[e] - at[f])})
    return out


def blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[list]:
    """Broadcasts of the benchmark's blocks, about ``block_bytes`` of text each, ``BLOCKS_HELD`` at a time; the driver makes one block at a time."""
    rows = pick(benchmark, "item_id", "text").where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for first in range(0, n, BLOCKS_HELD):
        out = []
        for k in range(first, min(n, first + BLOCKS_HELD)):
            part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            got = sorted(((None if r.item_id is None else str(r.item_id), r.text) for r in part.collect()), key=lambda x: (x[0] or "", x[1]))
            out.append(benchmark.sparkSession.sparkContext.broadcast(block([i for i, _ in got], [t for _, t in got], width)))
        yield out


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_MATCH = "struct<item_id:string,item_word:long,doc_word:long,n_words:long>"
_HITS = f"at array<long>, size array<long>, items array<string>, unnamed boolean, matches array<{_MATCH}>"
_ARROW_MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])


@dataclass
class Hits:
    """Of a batch's documents: spans (document, word, size) that windows cover, the items that hold them, and longest matches."""

    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    items: list[set]
    matches: list[list[dict]]


def _hits(column: pa.Array, held: list[Block], width: int, matches: bool) -> tuple[np.ndarray, Hits]:
    """The number of words of each text, and the hits in it."""
    n = len(column)
    counts, out, shards = np.zeros(n, dtype=np.int64), Hits([], [set() for _ in range(n)], [[] for _ in range(n)]), [Shard(b, width) for b in held]

    def search(s: Shard) -> None:
        b = s.block
        doc, at, window = s.search()
        out.spans.append((doc, at, b.width[window].astype(np.int64)))
        pair = np.unique(doc * max(1, len(b.start)) + window)
        for d, w in zip((pair // max(1, len(b.start))).tolist(), (pair % max(1, len(b.start))).tolist(), strict=True):
            out.items[d].update(b.items[x] for x in b.holders[b.holder_at[w] : b.holder_at[w + 1]])
        if matches:
            for d, m in _longest(doc, at, window, b).items():
                out.matches[d] += m

    for first, end, data, offsets in chunks(column):
        w = words(data, offsets, ALNUM)
        counts[first:end] = np.diff(w.row_first)
        for s in shards:
            s.add(w.hash, w.row_first, first)
            if s.suffixes >= SHARD_SUFFIXES:
                search(s)
    for s in shards:
        search(s)
    return counts, out


def _hit_rows(docs: DataFrame, shared: list, width: int, matches: bool) -> DataFrame:
    """id, key and hits of the rows of docs(id, key, text) that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [s.value for s in shared]
        for batch in batches:
            _, h = _hits(batch.column(2), held, width, matches)
            rows = [k for k, x in enumerate(h.items) if x]
            at, size = {k: [] for k in rows}, {k: [] for k in rows}
            for spans in h.spans:
                for d, a, n in zip(*(x.tolist() for x in spans), strict=True):
                    at[d].append(a)
                    size[d].append(n)
            pick_rows = pa.array(rows, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pick_rows), batch.column(1).take(pick_rows), pa.array([at[k] for k in rows], type=pa.list_(pa.int64())), pa.array([size[k] for k in rows], type=pa.list_(pa.int64())),
                    pa.array([[x for x in h.items[k] if x is not None] for k in rows], type=pa.list_(pa.string())), pa.array([None in h.items[k] for k in rows], type=pa.bool_()),
                    pa.array([h.matches[k] for k in rows], type=pa.list_(_ARROW_MATCH)),
                ],
                names=["id", "key", "at", "size", "items", "unnamed", "matches"],
            )

    return docs.mapInArrow(releasing(run), f"id {docs.schema['id'].dataType.simpleString()}, key long, {_HITS}")


def _scan(docs: DataFrame, benchmark: DataFrame, width: int, share: float, block_bytes: int, clean_only: bool, matches: bool) -> DataFrame:
    columns, text_at, id_at = docs.columns, docs.columns.index("text"), docs.columns.index("doc_id")
    if clean_only:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    else:
        ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_RESULT}" + (f", matches array<{_MATCH}>" if matches else "")
    groups = blocks(benchmark, width, block_bytes)
    shared, earlier = next(groups), []
    for later in groups:  # one scan more for the blocks so far
        store = Stored(docs.sparkSession, "contamination") if not earlier else store
        keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
        earlier.append(store.write(_hit_rows(keyed, shared, width, matches), f"hits-{len(earlier)}"))
        shared = later
    rows, extra = docs, 0
    if earlier:
        parts = earlier[0]
        for x in earlier[1:]:
            parts = parts.union(x)
        # Rows of the same id and text have the same hits: one of them is enough.
        parts = parts.distinct().groupBy("id", "key").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("at", "size", "items")], F.max("unnamed").alias("unnamed"), F.flatten(F.collect_list("matches")).alias("matches"))
        renamed = docs.toDF(*[f"c{k}" for k in range(len(columns))])
        rows = renamed.join(parts, renamed[f"c{id_at}"].eqNullSafe(parts["id"]) & (F.xxhash64(renamed[f"c{text_at}"]) == parts["key"]), "left").drop("id", "key")
        extra = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [s.value for s in shared]
        for batch in batches:
            n_words, h = _hits(batch.column(text_at), held, width, matches)
            n = batch.num_rows
            if extra:
                at, size, items, unnamed, longest = (batch.column(extra + k).to_pylist() for k in range(5))
                some = [k for k in range(n) if at[k]]
                h.spans.append((np.repeat(some, [len(at[k]) for k in some]).astype(np.int64), np.array([x for k in some for x in at[k]], dtype=np.int64), np.array([x for k in some for x in size[k]], dtype=np.int64)))
                for k in range(n):
                    h.items[k].update(items[k] or ())
                    if unnamed[k]:
                        h.items[k].add(None)
                    h.matches[k] += longest[k] or ()
            n_hit = _covered(*(np.concatenate([x[k] for x in h.spans]) for k in range(3)), n)
            bad = (n_hit > 0) & (n_hit >= share * n_words)
            if clean_only:
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(~bad)) for c in batch.columns[: len(columns)]], names=columns)
                continue
            digests = [hashlib.sha256(",".join(sorted(i for i in x if i is not None)).encode()).hexdigest() for x in h.items]
            out = [batch.column(id_at), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in h.items], type=pa.int64()), pa.array(digests, type=pa.string()), pa.array(bad)]
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if matches:
                out, names = [*out, pa.array(h.matches, type=pa.list_(_ARROW_MATCH))], [*names, "matches"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(releasing(run), ddl)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: float = 0.05, block_bytes: int = 8 << 20, matches: bool = True) -> DataFrame:
    """For each row of docs(doc_id, text): n_words, n_hit (words in windows of ``width`` words that items have too; an item
    of fewer words is one window), n_items and items_sha256 of the items with such windows, contaminated (n_hit > 0 and
    n_hit >= share * n_words) and, on demand, the longest verbatim matches with their places in item and document.

    Null or wordless texts have no words, no hits and aren't contaminated; null or wordless items match nothing. Repeated
    documents are answered each; items that share an id are one; those without id are one as well, which items_sha256 leaves
    out. An empty benchmark leaves all clean. Columns beside these aren't read. The benchmark is broadcast in blocks of
    ``block_bytes``, ``BLOCKS_HELD`` for each scan of the documents, which aren't shuffled unless there are more.
    """
    return _scan(pick(docs, "doc_id", "text"), pick(benchmark, "item_id", "text"), width, share, block_bytes, False, matches)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: float = 0.05, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that find_contamination() doesn't call contaminated."""
    pick(docs, "doc_id", "text")
    return _scan(docs, pick(benchmark, "item_id", "text"), width, share, block_bytes, True, False)
