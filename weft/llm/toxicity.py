"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration, learnt from labelled rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import pick, releasing

WORD = re.compile(r"[^\W_]+")
_OBSCURED = re.compile(r"(?<!\S)[^\W\d_]+(?:[\d@$!*.\-_+|]+[^\W\d_]+)+|(?<!\w)[^\W\d_](?:[ .\-*_][^\W\d_]){3,}(?!\w)")
_TRIPLE = re.compile(r"(.)\1{2,}")
_NOT_LETTER = re.compile(r"[\W\d_]+")

# Second-person words of four languages, and letters that digits and signs stand for.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros vuestro".split())
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"})

FEATURES = (
    "lexicon density", "lexicon hits", "distinct lexicon words", "weight density", "most hits in 40 words", "hits near second person",
    "second person", "capitals", "exclamations", "punctuation", "obscured words", "words",
)
_UPPER = bytes(range(65, 91))
_SHOUT = b"!?"
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[]^_{|}~"


def _entries(text: str, most: int = 8) -> Counter:
    """A text's candidates for the lexicon, its words, ended by $, and their first 4 to 8 letters, and how often it has each, ``most`` times at most."""
    out: Counter = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        if not w.isdigit():
            out[f"{w}$"] += n
            for k in range(4, min(8, len(w)) + 1):
                out[w[:k]] += n
    return Counter({e: n if n < most else most for e, n in out.items()})


@dataclass
class Counts:
    """Of a set of texts: how many have an entry, how often they have it, and how many there are."""

    texts: Counter = field(default_factory=Counter)
    times: Counter = field(default_factory=Counter)
    n: int = 0

    def add(self, entries: Counter) -> None:
        self.texts.update(entries.keys())
        self.times.update(entries)
        self.n += 1

    def merge(self, other: Counts, sign: int = 1) -> Counts:
        for mine, its in ((self.texts, other.texts), (self.times, other.times)):
            for e, k in its.items():
                mine[e] += sign * k
        self.n += sign * other.n
        return self


def lexicon(toxic: Counts, clean: Counts, least: int = 3, evidence: float = 6.0, least_odds: float = 1.5) -> dict[str, float]:
    """Entries that mark toxic texts: the log odds of their occurrences. Evidence is a log likelihood ratio of the texts that
    have them, which has to outweigh the number of entries tried as well."""
    if not toxic.n or not clean.n:
        return {}
    base, out = toxic.n / (toxic.n + clean.n), {}
    evidence = max(evidence, 1.5 + math.log(1 + sum(a >= least for a in toxic.texts.values())))
    for e, a in toxic.texts.items():
        if a < least:
            continue
        b = clean.texts[e]
        rate = a / (a + b)
        if rate <= base:
            continue
        g = a * math.log(rate / base) + (b * math.log((1 - rate) / (1 - base)) if b else 0.0)
        odds = math.log((toxic.times[e] + 0.5) / (toxic.n + 1)) - math.log((clean.times[e] + 0.5) / (clean.n + 1))
        if g > evidence and odds > least_odds:
            out[e] = odds
    return out


def copies(texts: list[str], bands: int = 6, rows: int = 2) -> np.ndarray:
    """A number for each text, the same for exact and near copies, found by bands of minimal hashes of five-word shingles."""
    first: dict[tuple, int] = {}
    group = list(range(len(texts)))

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    salts = np.random.default_rng(17).integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    for k, t in enumerate(texts):
        w = WORD.findall(t.lower())
        h = np.array([zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(w) - 4))], dtype=np.uint64)
        least = [int((((h + np.uint64(1)) * s) >> np.uint64(20)).min()) for s in salts]
        for b in range(bands):
            seen = first.setdefault((b, *least[b * rows : (b + 1) * rows]), k)
            if seen != k:
                group[root(k)] = root(seen)
    return np.array([root(k) for k in range(len(texts))], dtype=np.int64)


class Weights(dict):
    """Weights of words by the lexicon, kept for words met before; 0 for most."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: str) -> float:
        get = self.entries.get
        w = max(get(f"{word}$", 0.0), *(get(word[:k], 0.0) for k in range(4, 9)))
        if not w and _TRIPLE.search(word):
            w = max(self.entries.get(f"{short}$", 0.0) for short in (_TRIPLE.sub(r"\1", word), _TRIPLE.sub(r"\1\1", word)))
        if len(self) >= 300_000:  # memory stays bounded
            self.clear()
        self[word] = w
        return w


def features(text: str | None, weights: Weights) -> list[float]:
    """The dense features of a whole text; zeros for null, empty or wordless texts."""
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hits = [(i, w) for i, w in enumerate(words) if weights[w]]
    weight = sum(weights[w] for _, w in hits)
    names = {w for _, w in hits}
    obscured = 0
    for m in _OBSCURED.finditer(low):
        obscured += 1
        word = _NOT_LETTER.sub("", m[0].translate(STANDS_FOR))
        if weights[word] and word not in names:
            at = len(WORD.findall(low[: m.start()]))
            hits.append((at, word))
            weight += weights[word]
    hits.sort()
    near = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    close = most = low_end = p = 0
    for k, (i, _) in enumerate(hits):
        while hits[low_end][0] <= i - 40:
            low_end += 1
        most = max(most, k - low_end + 1)
        while p < len(near) and near[p] < i - 5:
            p += 1
        close += p < len(near) and near[p] <= i + 5
    raw = text.encode("utf-8", "replace")
    size = len(raw)
    less = lambda chars: (size - len(raw.translate(None, chars))) / size
    h = len(hits)
    return [h / n, math.log1p(h), math.log1p(len(names)), weight / n, float(most), close / n, len(near) / n, less(_UPPER), less(_SHOUT), less(_PUNCT), obscured / n, math.log1p(n)]


@dataclass
class Trees:
    """Boosted regression trees of the logistic loss over binned features."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, border, value by node; children of k: 2k+1, 2k+2

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, border, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > border[at]), at)
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Fits trees by second-order boosting; deterministic, ties go to the earlier feature and lower border."""
    share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    model = Trees(math.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [np.unique(np.append(e, x[x[:, f] > 0, f].min() / 2)) if (x[:, f] > 0).any() else e for f, e in enumerate(edges)]
    code = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    width = max(len(e) for e in edges) + 1
    raw = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        nodes = 2 ** (depth + 1) - 1
        feature, border, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(nodes):
            mine = np.flatnonzero(at == node)
            if not len(mine):
                continue
            gs, hs = g[mine].sum(), h[mine].sum()
            value[node] = -rate * gs / (hs + ridge)
            if node >= 2**depth - 1:
                continue
            best = (1e-6, -1, 0)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = code[mine, f]
                gl = np.cumsum(np.bincount(c, weights=g[mine], minlength=width))[: len(e)]
                hl = np.cumsum(np.bincount(c, weights=h[mine], minlength=width))[: len(e)]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least * 1e-2) | (hs - hl < least * 1e-2)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] >= 0:
                feature[node], border[node] = best[1], edges[best[1]][best[2]]
                at[mine] = 2 * node + 1 + (code[mine, best[1]] > best[2])
        model.trees.append((feature, border, value))
        leaf = at
        raw = raw + value[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: borders of raw scores and the rising probabilities at them."""
    order = np.lexsort((y, score))
    blocks: list[list[float]] = []  # sum, weight, lowest, highest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, w2, _, hi = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += w2
            blocks[-1][3] = hi
    at, p = [], []
    for v, w, lo, hi in blocks:
        rate = (v + 0.02) / (w + 0.04)
        at += [lo, hi] if hi > lo else [lo]
        p += [rate, rate] if hi > lo else [rate]
    return np.array(at), np.maximum.accumulate(np.array(p))


@dataclass
class Model:
    entries: dict[str, float]
    trees: Trees
    at: np.ndarray
    p: np.ndarray

    def scores(self, texts: list[str | None], weights: Weights) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not len(self.at):
            return np.zeros(len(texts))
        raw = self.trees.raw(np.array([features(t, weights) for t in texts]))
        return np.clip(np.interp(raw, self.at, self.p), 0.0, 1.0)


def fit(texts: list[str], labels: list[int], folds: int = 5) -> Model:
    """The lexicon that features of a row are made with is never learnt from that row, nor the calibration from the
    scores of trees that saw it. Without rows of both labels the score is 0 for all."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model({}, Trees(), np.zeros(0), np.zeros(0))
    group = copies(texts)
    fold = np.empty(len(y), dtype=np.int64)
    # All copies of a text are in one fold, dealt by the label of the first.
    heads = np.unique(group)
    for v in (0, 1):
        of = heads[y[heads] == v]
        fold[of] = np.arange(len(of)) % folds
    fold = fold[group]
    by = [(Counts(), Counts()) for _ in range(folds)]
    counted: set[tuple[int, int]] = set()
    for t, v, k, g in zip(texts, labels, fold.tolist(), group.tolist(), strict=True):
        if (g, v) not in counted:  # copies count once
            counted.add((g, v))
            by[k][v].add(_entries(t))
    clean, toxic = Counts(), Counts()
    for b in by:
        clean.merge(b[0])
        toxic.merge(b[1])
    x = np.zeros((len(y), len(FEATURES)))
    for k, b in enumerate(by):
        clean.merge(b[0], -1)
        toxic.merge(b[1], -1)
        weights = Weights(lexicon(toxic, clean))
        clean.merge(b[0])
        toxic.merge(b[1])
        for r in np.flatnonzero(fold == k):
            x[r] = features(texts[r], weights)
    raw = np.zeros(len(y))
    for k in range(folds):
        if (seen := fold != k).any() and (~seen).any():
            raw[~seen] = boost(x[seen], y[seen]).raw(x[~seen])
    at, p = isotonic(raw, y)
    return Model(lexicon(toxic, clean), boost(x, y), at, p)


def held_out(doc_id):
    """True for the rows whose labels are never read."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame, max_rows: int = 5000) -> Model:
    """Learns from about ``max_rows`` rows of labels(doc_id, toxic) at most: those of the smallest hashes of doc_id that
    aren't held out and whose document has text. Null labels are none; of several labels of a document the largest holds."""
    known = pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, max_rows / max(1, n)) * (1 << 20))
    rows = pick(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(known, "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "toxic", "text")
    got = sorted(((r.h, r.doc_id, r.toxic, r.text) for r in rows.toLocalIterator()))
    return fit([t for *_, t in got], [v for _, _, v, _ in got])


def _scores(shared) -> Callable[[pa.Array], np.ndarray]:
    own = shared.value
    weights = Weights(own.entries)
    return lambda column: own.scores(column.to_pylist(), weights)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier) and predicted (score >= threshold) of each row of docs(doc_id, text).

    Null, empty and wordless texts have a score as well. Repeated rows are scored each; other columns aren't read.
    """
    rows = pick(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores_of = _scores(shared)
        for b in batches:
            scores = scores_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(releasing(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whatever their names, that score_toxicity() doesn't call toxic."""
    names, text_at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores_of = _scores(shared)
        for b in batches:
            clean = pa.array(scores_of(b.column(text_at)) < threshold)
            yield pa.RecordBatch.from_arrays([c.filter(clean) for c in b.columns], names=names)

    return docs.mapInArrow(releasing(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
