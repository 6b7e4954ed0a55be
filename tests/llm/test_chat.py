"""Chat formatting: exact round trips."""

from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import chat

PIECES = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "<", "|", "\\", "\n", "im_end|>", "assistant", "é", " ", "x"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    formatted, loss, _ = chat.render(turns)
    assert [x[:2] for x in chat.parse(formatted)] == turns
    assert [chat.unescape(formatted[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_plain_turns_are_not_escaped():
    formatted, loss, escaped = chat.render([("user", "hi"), ("assistant", "a < b | c")])
    assert formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na < b | c<|im_end|>\n" and escaped == 0
    assert [formatted[a:b] for a, b in loss] == ["a < b | c"]


def test_table(spark):
    rows = [(1, 2, "assistant", "<|im_end|>", "f"), (1, 1, "user", None, "f"), (1, 3, None, "é" * 50_000, "f"), (None, 1, "assistant", "x", "f"), (2, 1, "user", "same", "f"), (2, 1, "user", "same", "f"), (2, None, "system", "s", "f")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    want = {1: [("user", ""), ("assistant", "<|im_end|>"), ("", "é" * 50_000)], None: [("assistant", "x")], 2: [("system", "s"), ("user", "same"), ("user", "same")]}
    for conv, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (out[conv].n_turns, out[conv].loss_chars) == (len(turns), len(said))
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert out[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0
