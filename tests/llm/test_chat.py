import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from winnow.llm import chat, queries

PIECES = st.lists(st.sampled_from([*chat.MARKERS, "<", "[", "\\", "/", "s>", "INST]", " ", "\n", "é", "ok"]), max_size=8)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[END]"]), PIECES.map("".join)), max_size=5))
def test_round_trip(turns):
    pieces = [chat.format_turn(role, text) for role, text in turns]
    assert chat.parse(chat.BEGIN + "".join(p for p, _, _ in pieces)) == turns
    for (role, text), (piece, start, end) in zip(turns, pieces):
        if role in ("user", "assistant"):
            assert chat.unescape(piece[start:end]) == text


def test_plain_text_is_not_escaped():
    assert chat.format_turn("user", "a\\b <b> [x]")[0] == "[INST] a\\b <b> [x] [/INST]"


@pytest.mark.parametrize("text", ["", "x", "<s>[INST] a", "<s>[INST]  [/INST]x", "<s> a</s></s>", "<s>[ROLE]a[END]"])
def test_parser_refuses_what_the_grammar_lacks(text):
    assert chat.parse(text) is None


def brute(rows):
    conversations = {}
    for conv_id, turn, role, text in rows:
        conversations.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv_id, turns in conversations.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        chars = 3 + sum(len(chat.format_turn(r, t)[0]) for r, t in turns)
        out.append((conv_id, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    hard = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    assert got(queries.LLM_QUERIES["op4_chat_formatting"](spark, sf_dir)) == brute(rows)


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "first"), (1, 2, None, None),
            (None, 1, "assistant", "lost"), (None, 0, "tool", "[END]"), (2, 0, "assistant", "x" * 500_000), (3, 0, "user", "")]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], f"{schema}, piece string, loss_start int")
    assert got(chat.read_back(chat.format_turns(df))) == brute(rows)
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0
