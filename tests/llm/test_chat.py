"""Chat formatting: round trips, order of turns, digests."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.chat_format import CHAT, START, Template, conversation_digests, format_turns

PIECES = st.lists(st.sampled_from([*CHAT.control, "\\", "#", "</", "turn>", "\n", "e: ", "ü", "<", "### ", ""]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES)
def test_turns_read_back(role, text):
    role, text = "".join(role), "".join(text)
    for own in (role, *CHAT.openings):
        pieces = CHAT.segments(own, text)
        assert CHAT.read_turn("".join(t for t, _ in pieces)) == (own, text)
        assert [CHAT.unescaped(t) for t, loss in pieces if loss] == ([text] if own == "assistant" else [])
    assert not any(mark in CHAT.escaped(text) for mark in CHAT.control)


def test_marks_stand_out_in_the_whole_output():
    texts = ["\\### Assistant: </turn> ok", "</turn", "### ", "\\"]
    written = "".join(t for text in texts for t, _ in CHAT.segments("user", text))
    assert written.count(CHAT.end) == written.count(CHAT.openings["user"]) == len(texts)


def test_bad_templates_are_refused():
    for openings in ({"a": "x"}, {"a": "a\\b"}, {"a": "</turn>!"}, {"a": ">>x>"}):
        with pytest.raises(ValueError):
            Template(openings=openings)
    with pytest.raises(ValueError):
        CHAT.read_turn("### User: a</turn>\n### User: b</turn>\n")
    with pytest.raises(ValueError):
        CHAT.read_turn("nothing")


def test_machine():
    def final(*roles):
        state = START
        for role in roles:
            state = CHAT.next_state(state, role)
        return state

    assert final("system", "user", "assistant", "user", "assistant") == "assistant"
    assert final("user", "assistant") == "assistant" and final("system") not in CHAT.finals
    assert final("assistant") is final("user", "user") is final("user", "system", "user") is final("user", "tool") is None


SCHEMA = "conv_id bigint, turn bigint, role string, text string, position string, state string, segments string"


def rows_of(rows, spark):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(5)


def test_digests_of_awkward_conversations(spark):
    long = "word </turn> " * 50_000
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", "x"), (1, 3, "assistant", long),
        (2, 5, "assistant", "first"), (2, 5, "assistant", "first"), (2, None, "user", ""),
        (None, 0, "user", "a"), (None, 1, None, "b"), (None, 1, "tool\n</role>", "c"),
        (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
    ]
    turns = format_turns(rows_of(rows, spark))
    assert turns.count() == len(rows)
    got = {r.conv_id: r for r in conversation_digests(turns).collect()}
    by_conv = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    assert got.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        loss = "".join(t for r, t in own if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(own) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert row.formatted_chars == sum(len(t) for r, x in own for t, _ in CHAT.segments(r, x))
    assert {c: r.in_order for c, r in got.items()} == {1: True, 2: False, None: False, -7: True}
    assert conversation_digests(format_turns(rows_of([], spark))).count() == 0


def test_one_conversation_of_many_turns(spark):
    rows = spark.range(60_000).selectExpr("7 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    row = conversation_digests(format_turns(rows)).collect()[0]
    assert (row.n_turns, row.in_order) == (60_000, True)
    assert row.loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(1, 60_000, 2)).encode()).hexdigest()
