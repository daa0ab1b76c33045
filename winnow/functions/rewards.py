"""Answer comparison and rewards. STR-6..12, UDF-1, UDF-2."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col, let
from .text import (
    THINK_ANSWER_PATTERN,
    answer_candidate,
    count_boxed,
    extract_boxed,
    normalise_answer,
)

# Reward weights and comparison tolerance.
ACCURACY_WEIGHT = 2.0
FORMAT_WEIGHT = 1.0
TOLERANCE = 1e-6

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
_QUOTIENT = rf"^({_NUMBER})/({_NUMBER})$"
_FRACTION = rf"^([+-]?)\\[dt]?frac\{{({_NUMBER})\}}\{{({_NUMBER})\}}$"


def to_number(text) -> Column:
    """Number written in a string, NULL when it is not one.

    Accepts what a Python ``float()`` accepts for finite ASCII numbers: surrounding
    white space, signs, exponents and single underscores between digits; not ``1d``.
    """
    space = r"[\s\x1c-\x1f]*"
    found = F.regexp_extract(as_col(text), rf"(?U)^{space}({_NUMBER}){space}\z", 1)
    return F.replace(found, F.lit("_"), F.lit("")).try_cast("double")


def rational_value(text) -> Column:
    """Value of a number, a quotient ``a/b`` or a ``\\frac{a}{b}`` of numbers."""
    text = as_col(text)
    quotient = F.try_divide(
        to_number(F.regexp_extract(text, _QUOTIENT, 1)),
        to_number(F.regexp_extract(text, _QUOTIENT, 2)),
    )
    sign = F.when(F.startswith(text, F.lit("-")), -1.0).otherwise(1.0)
    fraction = sign * F.try_divide(
        to_number(F.regexp_extract(text, _FRACTION, 2)),
        to_number(F.regexp_extract(text, _FRACTION, 3)),
    )
    return (
        F.when(F.contains(text, F.lit("frac{")), fraction)
        .when(F.contains(text, F.lit("/")), quotient)
        .otherwise(to_number(text))
    )


def _close(left: Column, right: Column) -> Column:
    # NaN sorts above every number in Spark, so `<` is already false for NaN.
    return F.coalesce(F.abs(left - right) < TOLERANCE, F.lit(False))


def _normalised(predicted, gold, strict: bool, same: Callable[[Column, Column], Column]) -> Column:
    pair = F.struct(
        normalise_answer(predicted, strict).alias("left"),
        normalise_answer(gold, strict).alias("right"),
    )
    return let(pair, lambda p: same(p["left"], p["right"]))


def numerically_equal(left, right) -> Column:
    """Two normalised answers agree as text or as numbers."""
    left, right = as_col(left), as_col(right)
    return F.coalesce(
        (left == right) | _close(to_number(left), to_number(right)), F.lit(False)
    )


def rationally_equal(left, right) -> Column:
    """Two normalised answers agree as text, numbers or quotients of numbers."""
    left, right = as_col(left), as_col(right)
    return F.coalesce(
        (left == right) | _close(rational_value(left), rational_value(right)), F.lit(False)
    )


def answers_equal(predicted, gold, strict: bool = True) -> Column:
    """STR-6. Normalised texts agree, or both are numbers that differ by under 1e-6."""
    return _normalised(predicted, gold, strict, numerically_equal)


def answers_equivalent(
    predicted, gold, verifier: Callable[[Column, Column], Column] | None = None
) -> Column:
    """STR-7. Equal as text, number or rational; a verifier may accept more.

    ``verifier`` maps the raw columns to a nullable boolean, NULL meaning "no opinion". It sees
    NULL where the answers are the same natively. To have each pair checked once over a whole
    frame, see :func:`winnow.operators.scoring.with_equivalence`.
    """
    predicted, gold = as_col(predicted), as_col(gold)
    same = _normalised(predicted, gold, True, rationally_equal)
    if verifier is None:
        return same
    return F.coalesce(verifier(F.when(~same, predicted), F.when(~same, gold)), F.lit(False)) | same


def python_verifier(check: Callable[[str, str], bool]) -> Callable[[Column, Column], Column]:
    """UDF-2. Wrap a per-pair equality check as an Arrow-batched verifier.

    A check that raises, or meets a NULL, gives NULL and leaves the native comparison
    to decide, so malformed model output never fails a job.
    """

    def attempt(left, right):
        if left is None or right is None:
            return None
        try:
            return bool(check(left, right))
        except Exception:  # noqa: BLE001 - the check is user code over model output
            return None

    @F.pandas_udf("boolean")
    def verify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([attempt(a, b) for a, b in zip(left, right)], dtype="object")

    return verify


def accuracy_reward(completion, solution, verifier=None) -> Column:
    """STR-8. 2.0 when the final answer matches the gold answer, else 0.0."""
    candidate = answer_candidate(completion)
    if verifier is None:
        correct = let(candidate, lambda found: answers_equivalent(found, solution))
    else:
        correct = answers_equivalent(candidate, solution, verifier)
    return F.when(correct, ACCURACY_WEIGHT).otherwise(0.0)


def format_reward_boxed(completion, solution=None) -> Column:
    """STR-9. 1.0 when the text has exactly one box and that box closes."""
    valid = (count_boxed(completion) == 1) & extract_boxed(completion).isNotNull()
    return F.when(valid, FORMAT_WEIGHT).otherwise(0.0)


def format_reward_think_answer(completion, solution=None) -> Column:
    """STR-10. 1.0 when the whole text is a think block followed by an answer block."""
    valid = as_col(completion).rlike("(?sU)" + THINK_ANSWER_PATTERN)
    return F.when(valid, FORMAT_WEIGHT).otherwise(0.0)


RewardBuilder = Callable[[Column, Column], Column]

_REWARDS: dict[str, RewardBuilder] = {
    "accuracy_reward": accuracy_reward,
    "format_reward_boxed": format_reward_boxed,
    "format_reward_think_answer": format_reward_think_answer,
}
_BUILT_IN = dict(_REWARDS)
_STYLES = {
    "boxed": ("accuracy_reward", "format_reward_boxed"),
    "think_answer": ("accuracy_reward", "format_reward_think_answer"),
}


def register_reward(name: str, builder: RewardBuilder) -> None:
    """UDF-1. Add a reward: a function of (completion, solution) columns to a column."""
    _REWARDS[name] = builder


def is_built_in(name: str) -> bool:
    """Whether a name still stands for the reward that this module gives it."""
    return _REWARDS.get(name) is _BUILT_IN.get(name)


def reward_names(style: str) -> list[str]:
    """Names of a style's rewards, accuracy first; an unknown style is an error."""
    if style not in _STYLES:
        raise ValueError(f"unknown prompt style {style!r}; expected one of {sorted(_STYLES)}")
    return list(_STYLES[style])


def reward_builder(name: str) -> RewardBuilder:
    """A registered reward by name."""
    if name not in _REWARDS:
        raise ValueError(f"unknown reward {name!r}; expected one of {sorted(_REWARDS)}")
    return _REWARDS[name]


def outcome_class(format_reward, accuracy) -> Column:
    """STR-12. One of the four format-by-answer outcomes, with its signal."""
    fmt, acc = as_col(format_reward) > 0, as_col(accuracy) > 0
    return (
        F.when(fmt & acc, "format+answer: clean positive")
        .when(~fmt & ~acc, "neither: clean negative")
        .when(fmt, "format only: ambiguous")
        .otherwise("answer only: ambiguous")
    )
