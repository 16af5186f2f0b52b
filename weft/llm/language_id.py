"""Language of texts: script ranges narrow the candidates, Viterbi over word scores with a switching penalty labels spans."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import pick

#: Runs of over 60 letters are several words, so that a change of language within one is seen.
WORD = re.compile(r"[^\W\d_]{1,60}")
#: Numerals that patterns take for letters, such as fractions and circled numbers.
_NUMERAL = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")


def letters(text: str) -> str:
    """text with blanks for numerals that aren't digits."""
    return text if text.isascii() or not _NUMERAL.search(text) else _NUMERAL.sub(" ", text)


def runs(text: str) -> list[str]:
    """The words of letters(text). Numerals are looked for only if some word isn't letters alone, as the pattern takes each of them into a word."""
    found = WORD.findall(text)
    return found if "".join(found).isalpha() else WORD.findall(letters(text))


# First code point and script of ranges, in order; "" is a script that none of these names.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, ""), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, ""), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""),
    (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"), (0x3190, ""), (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0xA000, ""), (0xA640, "cyrillic"), (0xA720, "latin"),
    (0xA800, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, ""),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, ""), (0x20000, "han"),
]
_FROM = [a for a, _ in SCRIPTS]


def script(char: str) -> str:
    return SCRIPTS[bisect_right(_FROM, ord(char)) - 1][1]


#: Scores that are worked on together, a word's of one language each: texts are grouped to about so many, and new words scored in lots of them.
GROUP_SCORES = 1 << 17


def points(words: list[str], before: str = "", after: str = "") -> np.ndarray:
    """The code points of all words, each between before and after."""
    return np.frombuffer((before + f"{after}{before}".join(words) + after).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


class _Rows(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        return row


@dataclass
class Model:
    """Languages, the scripts that each is written in, and log probabilities of letter groups and common words by language."""

    langs: list[str]
    scripts: dict[str, np.ndarray]  # of each script: whether a language is a candidate
    groups: dict[str, int]  # rows of logs
    logs: np.ndarray  # the last row: of groups never seen
    words: dict[str, np.ndarray]
    penalty: float = 12.0
    clip: float = 6.0
    _row: _Rows = field(default_factory=_Rows, repr=False)
    _memo: np.ndarray | None = field(default=None, repr=False)

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of lower-case words by language: 0 for a word's best, -clip at least, in whole 2^-24, so that sums are exact in any order."""
        first = len(self._row)
        rows = self._rows(words)
        if len(self._row) > first:
            room = max(1000, 1_500_000 // len(self.langs))  # memory stays bounded; scores don't depend on it
            if first and len(self._row) > len(self._memo):
                self._row.clear()
                first, rows = 0, self._rows(words)
            if self._memo is None or len(self._row) > len(self._memo):
                self._memo = np.empty((max(room, len(self._row)), len(self.langs)))
            new = list(islice(reversed(self._row), len(self._row) - first))[::-1]
            lot = max(1, GROUP_SCORES // len(self.langs))
            for k in range(0, len(new), lot):
                self._memo[first + k : first + min(k + lot, len(new))] = self._new(new[k : k + lot])
        return self._memo[rows]

    def _rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self._row.__getitem__, words), dtype=np.int64, count=len(words))

    @cached_property
    def _lookup(self) -> tuple[np.ndarray, np.ndarray, dict[str, int], np.ndarray, np.ndarray]:
        """What _new looks up: keys of letter groups in order and their rows, rows of common words and what each adds, the
        languages that each range of SCRIPTS leaves out."""
        keys = _keys(points(list(self.groups)))[::3] if self.groups else np.empty(0, dtype=np.uint64)
        order = np.argsort(keys)
        keys = np.append(keys[order], np.uint64((1 << 64) - 1))  # above any group, so that a search ends on an entry
        group_rows = np.append(np.fromiter(self.groups.values(), dtype=np.int64, count=len(self.groups))[order], len(self.logs) - 1)
        added = np.zeros((len(self.words) + 1, len(self.langs)))
        for k, v in enumerate(self.words.values()):
            added[k] = v
        barred = np.array([~self.scripts[x] if x in self.scripts else np.zeros(len(self.langs), dtype=bool) for _, x in SCRIPTS])
        return keys, group_rows, dict(zip(self.words, range(len(self.words)), strict=True)), added, barred

    def _new(self, words: list[str]) -> np.ndarray:
        keys, group_rows, common, added, barred = self._lookup
        code = points(words, "^", "$")
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(size) - size  # of each word's groups, of which it has one for each letter
        key = _keys(code)[np.arange(int(size.sum())) + 2 * np.repeat(np.arange(len(words)), size)]
        at = np.searchsorted(keys, key)
        total = np.add.reduceat(self.logs[np.where(keys[at] == key, group_rows[at], len(self.logs) - 1)], starts, axis=0)
        total += added[np.fromiter((common.get(w, -1) for w in words), dtype=np.int64, count=len(words))]
        total[barred[np.searchsorted(_FROM, code[starts + 2 * np.arange(len(words)) + 1], "right") - 1]] = -np.inf
        return np.round(np.maximum(total - total.max(axis=1, keepdims=True), -self.clip) * (1 << 24)) / (1 << 24)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(first character, end character, language index) of spans of one language, over all words in order."""
        found = list(WORD.finditer(letters(text)))
        if not found:
            return []
        path = self.path(self.score([m[0].lower() for m in found]))
        edges = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(found)]
        return [(found[a].start(), found[b - 1].end(), int(path[a])) for a, b in zip(edges, edges[1:])]

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best sequence of languages: the words' scores less the penalty for each switch; ties go to the earlier language."""
        n, langs = scores.shape
        best = int(scores.sum(axis=0).argmax())
        # If no run of words gains more elsewhere than half a switch costs, the one language is the best path: k runs off it
        # take k - 1 switches or more.
        gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, langs)), gain[:-1]]), axis=0)
        if (gain - low).max() <= self.penalty / 2:
            return np.full(n, best)
        return self._viterbi(scores)

    def _viterbi(self, scores: np.ndarray) -> np.ndarray:
        n, langs = scores.shape
        back = np.empty((n, langs), dtype=np.int16)
        value = scores[0].copy()
        own = np.arange(langs)
        k, step, single = 1, 32, 0
        while k < n:
            top = int(value.argmax())
            if single:  # where the leading language changes every few words
                stay = value >= value[top] - self.penalty
                back[k] = np.where(stay, own, top)
                value = np.where(stay, value, value[top] - self.penalty) + scores[k]
                k, single = k + 1, single - 1
                continue
            # As long as top leads, each other language's lead over a switch from top goes by itself: it's a sum of gains
            # that is kept from falling below 0.
            gain = scores[k : k + step] - scores[k : k + step, top : top + 1]
            lead = np.vstack([np.maximum(value - value[top] + self.penalty, 0)[None], gain])
            np.cumsum(lead, axis=0, out=lead)
            lead -= np.minimum(np.minimum.accumulate(lead, axis=0), 0)
            reached = lead[:-1] + gain
            ahead = reached > self.penalty
            ahead[:, :top] |= reached[:, :top] == self.penalty
            found = ahead.any(axis=1)
            last = int(found.argmax())
            changed = bool(found[last])
            count = last + 1 if changed else len(gain)
            stay = np.vstack([(value >= value[top] - self.penalty)[None], reached[: count - 1] >= 0])
            back[k : k + count] = np.where(stay, own, top)
            value = reached[count - 1]
            k += count
            if changed and count < 16:
                single = 64
            step = 32 if changed else min(2 * step, 4096)
        path = np.empty(n, dtype=np.int64)
        lang, end, switches = int(value.argmax()), n, {}
        while end:
            if lang not in switches:
                switches[lang] = np.flatnonzero(back[1:, lang] != lang) + 1
            before = int(np.searchsorted(switches[lang], end))
            begin = int(switches[lang][before - 1]) if before else 0
            path[begin:end] = lang
            if begin:
                lang = int(back[begin, lang])
            end = begin
        return path

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of most words' spans and a certainty of 0 to 1; und and 0 for a null text or one without a letter."""
        return next(self.predict_all([text]))

    def predict_all(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """predict of each text, in order; the words of many texts are scored together."""
        found, n = [], 0
        for text in texts:
            found.append(runs(text.lower()) if text and self.langs else [])
            n += len(found[-1])
            if n * len(self.langs) >= GROUP_SCORES:
                yield from self._votes(found)
                found, n = [], 0
        yield from self._votes(found)

    def _votes(self, found: list[list[str]]) -> Iterator[tuple[str, float]]:
        words = list(chain.from_iterable(found))
        every = self.score(words) if words else np.empty((0, len(self.langs)))
        size = np.fromiter(map(len, words), dtype=float, count=len(words))
        end = 0
        for own in found:
            begin, end = end, end + len(own)
            yield self._vote(every[begin:end], size[begin:end]) if own else ("und", 0.0)

    def _vote(self, scores: np.ndarray, weight: np.ndarray) -> tuple[str, float]:
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        path = self.path(scores)
        share = np.bincount(path, weights=weight, minlength=len(self.langs))
        best = int(share.argmax())
        margin = scores[path == best]
        rest = margin.sum(axis=0)
        own, rest[best] = rest[best], -np.inf
        sure = 1 / (1 + math.exp(-min(30.0, float(own - rest.max()) / math.sqrt(len(margin)))))
        return self.langs[best], round(float(share[best] / share.sum()) * sure, 6)


def _keys(code: np.ndarray) -> np.ndarray:
    """One number for each three code points that follow one another."""
    return (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]


def learn(samples: dict[str, list[str]]) -> Model:
    """From whole texts by language. A word counts once a text, so that no long or repetitive text outweighs the others."""
    langs = sorted(samples)
    groups: dict[str, Counter] = {}
    words: dict[str, Counter] = {}
    scripts: dict[str, Counter] = {}
    for lang in langs:
        words[lang] = Counter(w for t in samples[lang] for w in set(runs(t.lower())))
        groups[lang], scripts[lang] = Counter(), Counter()
        for w, n in words[lang].items():
            scripts[lang][script(w[0])] += n
            padded = f"^{w}$"
            for k in range(len(padded) - 2):
                groups[lang][padded[k : k + 3]] += n
    every = set().union(*groups.values()) if groups else set()
    size = len(every) + 1
    total = np.array([sum(groups[x].values()) for x in langs], dtype=float)
    order = sorted(every)
    logs = np.log((np.array([[groups[x][g] for x in langs] for g in [*order, ""]]).reshape(len(order) + 1, len(langs)) + 0.1) / (total + 0.1 * size))
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    for k, lang in enumerate(langs):
        for w, n in words[lang].items():
            if n >= 3:
                counts[w][k] = n
    all_words = np.array([sum(words[x].values()) for x in langs], dtype=float)
    common = {w: np.maximum(np.log((n + 0.5) / (all_words + 0.5)) - np.log((n + 0.5) / (all_words + 0.5)).max(), -3.0) for w, n in counts.items()}
    share = {s: np.array([scripts[x][s] / max(1, sum(scripts[x].values())) for x in langs]) for s in set().union(*scripts.values())} if langs else {}
    return Model(langs, {s: v >= 0.01 for s, v in share.items() if (v >= 0.01).any()}, dict(zip(order, range(len(order)), strict=True)), logs, common)


def held_out(doc_id):
    """True for the rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_model(docs: DataFrame, per_language: int = 800, max_languages: int = 500) -> Model:
    """Learns from about ``per_language`` documents of each language of docs(doc_id, text, lang), fewer if there are fewer:
    those of the smallest hashes of doc_id among rows that aren't held out and have text and lang. Beyond
    ``max_languages`` languages the call fails rather than drop some."""
    rows = pick(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    if not counts:
        return learn({})
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    samples: dict[str, list[str]] = defaultdict(list)
    for r in chosen.select("lang", "text").toLocalIterator():
        samples[r.lang].append(unicodedata.normalize("NFC", r.text))
    return learn(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs(doc_id, text), from the text alone.

    Null texts and those without a letter are ``und`` with score 0. Repeated rows are answered each, ties between languages
    go to the first by name, columns beside these two aren't read. With nothing to learn from, all rows are ``und``.
    """
    docs = pick(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            found = list(own.predict_all(t.as_py() for t in b.column(1)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "held_out": b.column(2), "lang_pred": pa.array([x for x, _ in found], type=pa.string()), "score": pa.array([s for _, s in found], type=pa.float64())})

    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
