"""Chat formatting by columnar byte assembly: segments' lengths, offsets and scatter indices in numpy, one preallocated buffer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._spark import pick
from ._words import utf8

#: Text bytes assembled at once; a longer conversation makes one larger piece.
PIECE_BYTES = 4 << 20


@dataclass(frozen=True)
class Template:
    """Marks of a turn. Both marks begin with ``<|``, which never stands in a text after escape()."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    learn_from: str = "assistant"

    def __post_init__(self):
        if not (self.start.startswith("<|") and self.end.startswith("<|")):
            raise ValueError("marks begin with <|")


def escape_column(column: pa.Array) -> pa.Array:
    """One more backslash between each < and | that have none or only backslashes between them."""
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _read_role(head: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head)) if "\\" in head else head


def read_chat(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for piece in formatted.split(template.start)[1:]:
        head, _, rest = piece.partition("\n")
        turns.append((_read_role(head), unescape(rest[: rest.rindex(template.end)])))
    return turns


def _assemble(ids: pa.Array, roles: pa.Array, texts: pa.Array, first: np.ndarray, template: Template) -> pa.RecordBatch:
    """first: the first row of each conversation, all of whose rows are here."""
    n = len(texts)
    marks = [template.start.encode(), b"\n", f"{template.end}\n".encode()]
    learnt = pc.fill_null(pc.equal(roles, template.learn_from), False).to_numpy(zero_copy_only=False)
    # A role is one line: its backslashes and line ends are escaped before its control strings are.
    roles = escape_column(pc.replace_substring(pc.replace_substring(pc.fill_null(roles, ""), "\\", "\\\\"), "\n", "\\n"))
    parts = [np.frombuffer(b"".join(marks), dtype=np.uint8)]
    role_bytes, role_at = utf8(roles)
    text_bytes, text_at = utf8(escape_column(pc.fill_null(texts, "")))
    pool = np.concatenate([*parts, role_bytes, text_bytes])
    a, b, c = (len(m) for m in marks)
    base_role, base_text = a + b + c, a + b + c + len(role_bytes)
    # Segments of a turn: start mark, role, line end, text, end mark.
    source = np.empty((n, 5), dtype=np.int64)
    length = np.empty((n, 5), dtype=np.int64)
    source[:, 0], length[:, 0] = 0, a
    source[:, 1], length[:, 1] = base_role + role_at[:-1], np.diff(role_at)
    source[:, 2], length[:, 2] = a, b
    source[:, 3], length[:, 3] = base_text + text_at[:-1], np.diff(text_at)
    source[:, 4], length[:, 4] = a + b, c
    target = np.zeros(5 * n + 1, dtype=np.int64)
    np.cumsum(length.ravel(), out=target[1:])
    total = int(target[-1])
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, dtype=np.uint8)
    np.take(pool, np.repeat(source.ravel() - target[:-1], length.ravel()) + np.arange(total), out=out)
    points = np.zeros(total + 1, dtype=np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=points[1:])

    bounds = np.append(first, n)
    conv_at = target[5 * bounds]
    conv = np.repeat(np.arange(len(first)), np.diff(bounds))
    text_start = points[target[3:-1:5]] - points[conv_at[:-1]][conv]
    text_end = points[target[4::5]] - points[conv_at[:-1]][conv]
    chosen = np.flatnonzero(learnt)
    span_at = np.searchsorted(chosen, bounds).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(text_start[chosen]), pa.array(text_end[chosen])], fields=[pa.field("start", pa.int64()), pa.field("stop", pa.int64())])
    if total >= 1 << 31:
        raise ValueError("a conversation of over 2 GiB doesn't fit a string")
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(conv_at.astype(np.int32)), buffer)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(first)), formatted, pa.array(np.diff(bounds)), pa.array(np.diff(points[conv_at])), pa.ListArray.from_arrays(pa.array(span_at), spans)],
        names=["conv_id", "formatted", "n_turns", "formatted_chars", "loss_spans"],
    )


def _starts(ids: pa.Array) -> np.ndarray:
    """Rows at which another conversation begins, row 0 among them."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])


def _pieces(rows: pa.Table, template: Template) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return
    ids, roles, texts = (rows.column(k).chunk(0) for k in (0, 2, 3))
    first = np.append(_starts(ids), len(ids))
    _, at = utf8(texts)
    conv = 0
    while conv < len(first) - 1:
        end = max(conv + 1, int(np.searchsorted(at[first], at[first[conv]] + PIECE_BYTES, "right")) - 1)
        lo, hi = int(first[conv]), int(first[end])
        yield _assemble(ids.slice(lo, hi - lo), roles.slice(lo, hi - lo), texts.slice(lo, hi - lo), first[conv:end] - lo, template)
        conv = end


def format_chat(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of conversations(conv_id, turn, role, text): conv_id, formatted, n_turns,
    formatted_chars and loss_spans, the code point ranges of formatted that hold texts to learn from.

    Turns stand in order of turn, ties in order of role and text; repeated rows are kept, null turns come first.
    A null role or text is empty; rows with a null conv_id are one conversation. read_chat() gives roles and texts back
    exactly, whatever they hold. Columns beside these four are not read. An empty table gives an empty one. A
    conversation is one string, so its rows meet in one task; no other grouping takes place.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = int(_starts(b.column(0))[-1])
            if last > 0 or waiting and waiting[-1].column(0)[-1].as_py() != b.column(0)[0].as_py():
                yield from _pieces(pa.Table.from_batches([*waiting, b.slice(0, last)]), template)
                waiting = [b.slice(last)]
            else:
                waiting.append(b)
        if waiting:
            yield from _pieces(pa.Table.from_batches(waiting), template)

    return rows.mapInArrow(run, f"conv_id {kind}, formatted string, n_turns long, formatted_chars long, loss_spans array<struct<start:long,stop:long>>")


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads formatted conversations back: digests of their turns and of the text under the loss mask."""
    import hashlib

    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = read_chat(text, template)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_pydict({"conv_id": b.column(0), **{k: pa.array(v, type=pa.string() if "sha" in k else pa.int64()) for k, v in out.items()}})

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
