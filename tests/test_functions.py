"""Answer scoring, formats and geometry on stated cases."""

import math
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow.functions import cells, geometry, rewards, text


def column(spark, values, build, kind="string"):
    """Values of a column expression over a list of inputs, in order."""
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("x"))).collect()]


def brute_boxed(value):
    """Every box that closes, by a stack of open braces; the one that begins last."""
    waiting, closed = [], {}
    for token in re.finditer(r"(\\boxed)?\{|\}", value):
        if token[0] != "}":
            waiting.append((token.end(), token[1]))
        elif waiting:
            begin, is_box = waiting.pop()
            if is_box:
                closed[begin] = value[begin:token.start()]
    return closed[max(closed)] if closed else None


BOXED = {
    r"the answer is \boxed{42}": "42",
    r"\boxed{\frac{1}{2}}": r"\frac{1}{2}",
    r"\boxed{a} then \boxed{b}": "b",
    r"\boxed{\text{x}^{2}}": r"\text{x}^{2}",
    "no box here": None,
    r"\boxed{unbalanced": None,
    r"\boxed{a} then \boxed{b": "a",
    r"\boxed{outer \boxed{inner}": "inner",
    r"\boxed{outer \boxed{inner} }": "inner",
    r"\boxed{}": "",
    r"\boxed{{{{{{deep}}}}}} tail }": "{{{{{deep}}}}}",
    r"} } \boxed{x} }": "x",
    r"\boxed{{{{{{deep}}}}}": None,
    "": None,
    "é\\boxed{ü{ß}}é": "ü{ß}",
}


def test_extract_boxed_cases(spark):
    assert column(spark, list(BOXED), text.extract_boxed) == list(BOXED.values())
    assert column(spark, list(BOXED), lambda c: text._last_balanced_box(c)) == list(BOXED.values())


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["\\boxed{", "{", "}", "a", "\\", "é", "\n"]), max_size=14),
                min_size=100, max_size=100))
def test_extract_boxed_matches_brute_force(spark, parts):
    values = ["".join(p) for p in parts]
    assert column(spark, values, text.extract_boxed) == [brute_boxed(v) for v in values]


def test_long_text_does_not_overflow(spark):
    values = [r"\boxed{" + "{x}" * 20000 + "}", r"\boxed{1} \boxed{" + "{" * 3000]
    assert column(spark, values, text.extract_boxed) == ["{x}" * 20000, "1"]


def test_many_open_boxes_take_linear_time(spark):
    """A repetition loop: two million braces that the earlier stack would take hours for."""
    values = [r"\boxed{\boxed{" + "{" * 1_000_000 + "}" * 3 + "{x}" * 300_000,
              r"\boxed{1} \boxed{" + r"\boxed{{" * 200_000 + "}" * 5,
              r"\boxed{" * 300_000]
    before = time.monotonic()
    assert column(spark, values, text.extract_boxed) == [brute_boxed(v) for v in values]
    assert time.monotonic() - before < 30


def test_numbers_and_candidates(spark):
    values = ["a 1 b -2.5 c", "1,234 then 5,6", "none", r"3 \boxed{}", r"3 \boxed{x"]
    assert column(spark, values, text.last_number) == ["-2.5", "5,6", None, "3", "3"]
    assert column(spark, values, text.answer_candidate) == ["-2.5", "5,6", None, "", "3"]
    assert column(spark, values, text.count_boxed) == [0, 0, 0, 1, 1]


NORMALISED = {
    "  $42$ ": "42",
    "1,234.": "1234",
    "1\\,000": "1\\000",
    "50\\%": "50",
    "a\\!b": "ab",
    "\\text{yes}": "yes",
    "\\text{open": "\\text{open",
    "x...": "x",
    "\u00a0\t7\n": "7",
    "$$": "",
}


def test_normalise_answer(spark):
    assert column(spark, list(NORMALISED), text.normalise_answer) == list(NORMALISED.values())
    relaxed = column(spark, ["1\\,000"], lambda c: text.normalise_answer(c, strict=False))
    assert relaxed == ["1000"]


NUMBERS = ["1", "-2.5", ".5", "5.", "1e3", "1_000", "1__0", "1d", "1f", "nan", "inf", "", "+7",
           "0x10", " 8 ", "1e400", "1.2.3", "\u00a09"]


def test_to_number_follows_python_for_finite_numbers(spark):
    def parse(value):
        try:
            number = float(value)
        except ValueError:
            return None
        return number if math.isfinite(number) or value == "1e400" else None

    assert column(spark, NUMBERS, rewards.to_number) == [parse(v) for v in NUMBERS]


EQUAL = [
    ("34", "34", True, True), ("34.0", "34", True, True), ("35", "34", False, False),
    (r"\frac{1}{2}", "0.5", False, True), ("0.5", "1/2", False, True),
    (r"-\dfrac{3}{4}", "-0.75", False, True), ("1/0", "1/0", True, True),
    ("1/0", "2", False, False), ("nan", "nan", True, True), ("nan", "inf", False, False),
    ("inf", "-inf", False, False), ("1.0000001", "1", True, True), ("1.00001", "1", False, False),
    (r"\frac{{{}}}", "1", False, False), ("", "", True, True), (None, "1", False, False),
    ("1", None, False, False), (r"\text{yes}", "yes", True, True),
]


def test_answer_equality(spark):
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(EQUAL)],
                                  "i int, a string, b string, literal boolean, rational boolean")
    checked = frame.select("i", "literal", "rational",
                           rewards.answers_equal("a", "b").alias("l"),
                           rewards.answers_equivalent("a", "b").alias("r")).collect()
    for row in checked:
        assert (row.l, row.r) == (row.literal, row.rational), EQUAL[row.i]


def test_failing_verifier_falls_back(spark):
    def check(left, right):
        if left == "boom":
            raise ValueError(left)
        return left == "yes"

    frame = spark.createDataFrame([(0, "boom", "boom"), (1, "boom", "x"), (2, "yes", "no"), (3, "a", "b")],
                                  "i int, a string, b string")
    verifier = rewards.python_verifier(check)
    same = frame.select("i", rewards.answers_equivalent("a", "b", verifier).alias("s"))
    assert [r.s for r in same.orderBy("i").collect()] == [True, False, True, False]


REWARDED = [
    (r"Reasoning... \boxed{34}", "34", 2.0, 1.0), (r"Reasoning... \boxed{35}", "34", 0.0, 1.0),
    (r"\boxed{\frac{1}{2}}", "0.5", 2.0, 1.0), (r"\boxed{0.5}", "1/2", 2.0, 1.0),
    ("step one, step two, so the total is 34", "34", 2.0, 0.0),
    (r"\boxed{\frac{{{}}}", "1", 0.0, 0.0), ("", "2", 0.0, 0.0),
    (r"\boxed{1} and \boxed{2}", "2", 2.0, 0.0), ("none", "1", 0.0, 0.0), (None, "1", 0.0, 0.0),
]


def test_rewards_as_columns_and_as_operator(spark):
    from winnow.operators.scoring import score

    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(REWARDED)],
                                  "i int, completion string, solution string, acc double, fmt double")
    direct = frame.select("acc", "fmt", rewards.accuracy_reward("completion", "solution").alias("a"),
                          rewards.format_reward_boxed("completion").alias("f")).collect()
    assert all((r.a, r.f) == (r.acc, r.fmt) for r in direct)
    for row in score(frame).collect():
        got = (row["rewards/accuracy_reward"], row["rewards/format_reward_boxed"], row["reward"])
        assert got == (row.acc, row.fmt, row.acc + row.fmt), row


def test_think_answer_layout(spark):
    values = ["<think>\nreasoning\n</think>\n<answer> 42 </answer>",
              "<answer> 42 </answer><think> reasoning </think>", "<think> reasoning </think>",
              " <think></think><answer></answer> \n", "x<think></think><answer></answer>"]
    assert column(spark, values, rewards.format_reward_think_answer) == [1.0, 0.0, 0.0, 1.0, 0.0]


def test_styles_and_names():
    assert rewards.reward_names("boxed") == ["accuracy_reward", "format_reward_boxed"]
    assert rewards.reward_names("think_answer") == ["accuracy_reward", "format_reward_think_answer"]
    with pytest.raises(ValueError):
        rewards.reward_names("nonexistent")
    with pytest.raises(ValueError):
        text.system_prompt("nonexistent")


def test_unknown_style_column_fails(spark):
    frame = spark.createDataFrame([("boxed",), ("other",)], "style string")
    with pytest.raises(Exception, match="unknown prompt style other"):
        frame.select(text.system_prompt(F.col("style"))).collect()


def test_completion_text(spark):
    chats = [[("user", "q"), ("assistant", r"\boxed{7}")], [("assistant", None)], [], None]
    assert column(spark, chats, text.completion_text, "array<struct<role:string,content:string>>") == [
        r"\boxed{7}", "", "", ""]


LOGS = {
    "{'completions/clipped_ratio': '0.08'} {'completions/clipped_ratio': '0.9'}": 0.08,
    "{'completions/clipped_ratio': '1'}": 1.0,
    "{'completions/clipped_ratio': '1.5e-02'}": 0.015,
    "{'loss': '0.1'}": None,
}


def test_first_clipped_ratio(spark):
    assert column(spark, list(LOGS), text.first_clipped_ratio) == list(LOGS.values())


def test_fixed_rounds_like_python(spark):
    values = [0.125, 0.375, 2.675, 1.005, 0.5, 1234567.891, -0.001, 0.0, 99.995, 1e-9, None]
    got = column(spark, values, lambda c: cells.fixed(c, 2), "double")
    assert got == ["--" if v is None else f"{v:.2f}" for v in values]


def test_latex_escape(spark):
    got = column(spark, ["minerva_math 50% a+/-b", "\\", "{~^&#$}"], cells.latex_escape)
    assert got == [r"minerva\_math 50\% a$\pm$b", r"\textbackslash\{\}",
                   r"\{\textasciitilde\{\}\textasciicircum\{\}\&\#\$\}".replace(r"\{\}", "{}")]


K_TABLE = [(16, 0.0, 16), (16, 0.5, 8), (16, 0.75, 4), (16, 0.875, 2), (16, 0.9375, 1), (8, 0.5, 4),
           (8, 0.99, 1), (3, 0.5, 1), (10, 0.8, 1), (5, 0.8, 1)]
M_TABLE = [(16, 16, 1), (16, 8, 2), (16, 4, 4), (16, 2, 8), (16, 1, 16), (16, 3, 5)]
WARMUP = [(10, 1, 10), (10, 2, 5), (10, 4, 3), (10, 8, 1), (1, 8, 1), (0, 8, 0)]


def test_geometry_tables(spark):
    k = spark.createDataFrame(K_TABLE, "g int, p double, k int")
    assert k.where(geometry.retained("g", "p") != F.col("k")).count() == 0
    m = spark.createDataFrame(M_TABLE, "g int, k int, m int")
    assert m.where(geometry.allocation_multiplier("g", "k") != F.col("m")).count() == 0
    w = spark.createDataFrame(WARMUP, "b int, m int, w int")
    assert w.where(geometry.scaled_warmup("b", "m") != F.col("w")).count() == 0


def test_the_verifier_sees_each_open_pair_once(spark):
    from winnow.operators.scoring import score, with_equivalence

    calls = spark.sparkContext.accumulator(0)

    def check(left, right):
        calls.add(1)
        return (left, right) in {("two", "2"), ("x", "y")}

    verifier = rewards.python_verifier(check)
    pairs = [("two", "2"), ("2", "2"), ("x", "y"), ("1/2", "0.5"), ("q", "r"), (None, "2"), ("q", None)]
    frame = spark.createDataFrame([(i, *pairs[i % 7]) for i in range(700)], "i int, a string, b string").repartition(5)
    got = with_equivalence(frame, "a", "b", verifier).collect()
    assert len(got) == 700 and all(r.equivalent == (r.i % 7 < 4) for r in got)
    assert calls.value == 3
    native = frame.select("i", rewards.answers_equivalent("a", "b", verifier).alias("s")).collect()
    assert {(r.i, r.s) for r in native} == {(r.i, r.equivalent) for r in got} and calls.value == 3 + 300
    texts = spark.createDataFrame(
        [(i, ["so \\boxed{two}", "\\boxed{2}", "\\boxed{three}", "none", None][i % 5], "2") for i in range(50)], "i int, completion string, solution string")
    calls.value = 0
    scored = score(texts, verifier=verifier)
    assert scored.columns == ["i", "completion", "solution", "rewards/accuracy_reward", "rewards/format_reward_boxed", "reward"]
    assert {(r.i % 5, r["rewards/accuracy_reward"]) for r in scored.collect()} == {(0, 2.0), (1, 2.0), (2, 0.0), (3, 0.0), (4, 0.0)}
    assert calls.value == 2
