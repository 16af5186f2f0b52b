"""Line-first cleaning: rules judge each line, failing lines go, then a document that lost too much text is rejected."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import pick

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")

# Phrases of site furniture, in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "javascript", "log in to", "lorem ipsum",
    "privacy policy", "read more", "share this", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_NAVIGATION = re.compile(r"(?:^|\s)(?:[|›»·•>]|::|->)(?=\s|$)")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the two document checks."""

    max_symbols_per_word: float = 0.3
    max_shouts_per_word: float = 0.3  # of ! and ?
    long_line_words: int = 60  # a line so long has some sentence mark
    max_upper: float = 0.6  # share of capitals among letters, in lines of upper_words or more
    upper_words: int = 5
    max_navigation: float = 0.2  # separators standing alone, per word
    min_navigation: int = 3
    max_stutter: float = 0.4  # words equal to the one before, in lines of stutter_words or more
    stutter_words: int = 8
    max_repeats: int = 3  # further copies of a line fail
    max_lost: float = 0.5  # share of word characters
    min_words: int = 10
    max_repeat_words: float = 0.2


def line_verdict(line: str, words: list[str], rules: Rules = Rules()) -> str | None:
    """The name of the first rule that the line, of one word at least, fails."""
    n_words = len(words)
    links = len(_NAVIGATION.findall(line))
    if links >= rules.min_navigation and links > rules.max_navigation * n_words:
        return "navigation"
    if len(SYMBOL.findall(line)) > rules.max_symbols_per_word * n_words and n_words >= 3:
        return "symbols"
    if line.count("!") + line.count("?") > rules.max_shouts_per_word * n_words and n_words >= 4:
        return "punctuation"
    if n_words >= rules.long_line_words and not any(c in line for c in ".!?;:,。！？、；：।؟"):
        return "punctuation"
    if n_words >= rules.stutter_words and sum(a == b for a, b in zip(words, words[1:])) > rules.max_stutter * n_words:
        return "stutter"
    if n_words >= rules.upper_words:
        upper = sum(map(str.isupper, line))
        if upper > 2 * n_words and upper > rules.max_upper * sum(map(str.isalpha, line)):
            return "boilerplate"
    if n_words <= 30 and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words that stand in a window of ``width`` words that occurs twice or more, its first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total = reach = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + width - max(i, reach)
            reach = i + width
    return total


def judge(text: str | None, rules: Rules = Rules()) -> dict:
    """All of a document's figures, its cleaned text and the verdict. None is the empty text, which is rejected."""
    text = text or ""
    words = WORD.findall(text)
    n_words, word_chars = len(words), sum(map(len, words))
    lines, seen, kept = text.split("\n"), Counter(), []
    n_dup_lines = lost = 0
    for line in lines:
        found = WORD.findall(line)
        if not found:
            kept.append(line)
            continue
        n_dup_lines += seen[line] > 0
        seen[line] += 1
        if seen[line] > rules.max_repeats or line_verdict(line, found, rules):
            lost += sum(map(len, found))
        else:
            kept.append(line)
    n_repeat = repeated_words(words)
    base_failed = n_words < rules.min_words or n_repeat > rules.max_repeat_words * n_words
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": len(SYMBOL.findall(text)), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": not base_failed and lost <= rules.max_lost * word_chars, "lost_chars": lost, "clean_text": "\n".join(kept) if lost else text,
    }


_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_chars", pa.int64()), ("clean_text", pa.string())]
_DDL = {"int64": "long", "bool": "boolean", "string": "string"}


def quality_rules(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """One row per row of docs(doc_id, text): its figures, verdict and cleaned text.

    A null text is the empty one: no words, base_failed, not kept. Rows with equal doc_id are judged each; other
    columns are not read, so that their names can't clash. An empty table gives an empty table.
    """
    fields = [f for f in _FIELDS if with_text or f[0] != "clean_text"]
    docs = pick(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(t.as_py(), rules) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[n] for x in found], type=t) for n, t in fields)], names=["doc_id", *(n for n, _ in fields)])

    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {_DDL[str(t)]}" for n, t in fields))
