import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import chat

pieces = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<||im_end|>", "<", "|", "im_", "<|", "\n", "%", "%0A", "a", "é😀", "assistant"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces, pieces)
def test_every_turn_comes_back(role, text):
    formatted, rounds = chat.format_turn(role, text)
    turns = chat.parse(formatted)
    assert len(turns) == 1 and chat.read_turn(*turns[0]) == (role, text) and rounds < 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), pieces), max_size=5))
def test_whole_conversations_come_back(turns):
    assert [chat.read_turn(*t) for t in chat.parse("".join(chat.format_turn(*t)[0] for t in turns))] == turns


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\na", "<|im_start|>u\n<|im_start|>\n<|im_end|>\n", "<|im_start|>u\na<|im_end|>"])
def test_parser_refuses(bad):
    assert chat.parse(bad) is None


def test_conversations_like_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [*chat.HOSTILE, (-2, 0, "user", None), (-2, 1, "assistant", ""), (-3, 5, "assistant", "<||im_end|>"), (-3, None, None, "first"), (-4, 1, "user", "b"), (-4, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, c int").repartition(5)
    turns = chat.formatted_turns(df)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(turns).collect()}
    expected = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(chat.format_turn(r[2] or "", r[3] or "")[0] for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        expected[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
    assert got == expected
    for r in chat.conversations(turns).collect():
        assert len(r.formatted) == expected[r.conv_id][4]
        assert hashlib.sha256("".join(chat.unescape(r.formatted[m.start : m.stop]) for m in r.loss).encode()).hexdigest() == expected[r.conv_id][3]


def test_empty_table(spark):
    assert chat.digests(chat.formatted_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
