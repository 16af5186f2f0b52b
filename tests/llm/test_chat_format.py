import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.chat_format import digest, escape, format_chat, read_chat, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


@given(st.text(alphabet="<|\\im_startend>\nà😀 ", max_size=40))
@settings(max_examples=300)
def test_escape_is_reversible_and_leaves_no_mark(text):
    assert unescape(escape(text)) == text
    assert "<|" not in escape(text)


def expected(rows):
    out = {}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:4])
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or "", r[2] == "assistant"))
    return {k: (len(v), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b, _ in v).encode()).hexdigest(), len(x := "".join(b for _, b, c in v if c)), hashlib.sha256(x.encode()).hexdigest()) for k, v in out.items()}


def test_round_trip_of_odd_rows(spark):
    rng = random.Random(5)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|", "\\", "\n", "é", "😀", "plain words", "", "<", "|"]
    rows = [(rng.choice([None, -1, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2]), rng.choice([None, "user", "assistant", "system", "a\nb\\n<|im_end|>"]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 6)))]), "x") for _ in range(300)]
    rows += [(9, 0, "assistant", "very long " * 300_000, "x")] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digest(format_chat(df)).collect()}
    assert got == expected(rows)


def test_formatted_text_and_spans(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "a<|b", ""), (1, 0, "user", "é?", "")], SCHEMA)
    [row] = format_chat(df).collect()
    assert row.formatted == "<|im_start|>user\né?<|im_end|>\n<|im_start|>assistant\na<\\|b<|im_end|>\n"
    assert [row.formatted[s.start : s.stop] for s in row.loss_spans] == ["a<\\|b"]
    assert row.formatted_chars == len(row.formatted)
    assert read_chat(row.formatted) == [("user", "é?"), ("assistant", "a<|b")]


def test_empty_table_and_missing_column(spark):
    assert format_chat(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        format_chat(spark.createDataFrame([(1,)], "conv_id long"))
