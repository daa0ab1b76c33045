"""Scoring and group-relative advantages. STR-11, JN-1, JN-4, WIN-1, WIN-6, FLT-3."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col
from ..functions.rewards import (
    ACCURACY_WEIGHT,
    FORMAT_WEIGHT,
    answers_equivalent,
    is_built_in,
    rationally_equal,
    reward_builder,
    reward_names,
)
from ..functions.text import count_boxed, extract_boxed, last_number, normalise_answer
from .skew import HOT_ROWS, lookup, with_group_stats

GROUP = ("run_id", "group_id")


def attach_solutions(
    rollouts: DataFrame, problems: DataFrame, key: str = "problem_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """JN-1. Add each completion's gold answer; a missing one is NULL and scores 0."""
    return lookup(rollouts, problems.select(key, "solution"), [key], hot_rows)


def with_run(rollouts: DataFrame, runs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """JN-4. Add run settings to every rollout."""
    return lookup(rollouts, runs, ["run_id"], hot_rows)


def score(
    df: DataFrame,
    style: str = "boxed",
    rewards: Sequence[str] | None = None,
    completion: str = "completion",
    solution: str = "solution",
    verifier: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """STR-11, UDF-1, UDF-2. Add ``rewards/<name>`` columns and their sum ``reward``.

    ``verifier`` may accept answers that the native comparison refuses, see
    :func:`winnow.functions.rewards.python_verifier`. A name that was registered anew
    stands for the new reward.
    """
    names = list(rewards) if rewards is not None else reward_names(style)
    text, gold = F.col(completion), F.col(solution)
    shared = [name for name in names if is_built_in(name)]
    staged = _answer_columns(df, text, gold, shared)
    correct = rationally_equal("_left", "_right")
    if verifier is not None and "accuracy_reward" in shared:
        staged = _verified(staged.withColumn("_same", correct), F.col("_candidate"), gold, verifier)
        correct = F.col("_same")
    built_in = {
        "accuracy_reward": F.when(correct, ACCURACY_WEIGHT),
        "format_reward_boxed": F.when(
            F.col("_boxed").isNotNull() & (count_boxed(text) == 1), FORMAT_WEIGHT
        ),
    }
    scored = staged.withColumns(
        {
            f"rewards/{name}": built_in[name].otherwise(0.0)
            if name in built_in and name in shared
            else reward_builder(name)(text, gold)
            for name in names
        }
    )
    total = F.lit(0.0)
    for name in names:
        total += F.coalesce(F.col(f"`rewards/{name}`"), F.lit(0.0))
    return scored.withColumn("reward", total).drop("_boxed", "_candidate", "_left", "_right", "_same")


def with_equivalence(
    df: DataFrame, predicted: str, gold: str, verifier: Callable[[Column, Column], Column], name: str = "equivalent"
) -> DataFrame:
    """UDF-2, STR-7. Add whether two answers are equal, natively or by a verifier that sees each open pair once."""
    same = df.withColumn("_same", answers_equivalent(predicted, gold))
    return _verified(same, F.col(f"`{predicted}`"), F.col(f"`{gold}`"), verifier).withColumnRenamed("_same", name)


def _verified(
    df: DataFrame, predicted: Column, gold: Column, verifier: Callable[[Column, Column], Column]
) -> DataFrame:
    """``_same`` with what the verifier accepts beside it.

    Completions of a group repeat their answers, so the pairs that are not the same natively are
    made distinct, verified once each and joined back; the others never reach Python or the
    join. A stream can't be joined with itself: there the verifier runs on every open row.
    """
    open_ = ~F.col("_same") & predicted.isNotNull() & gold.isNotNull()
    if df.isStreaming:
        verdict = verifier(F.when(open_, predicted), F.when(open_, gold))
        return df.withColumn("_same", F.col("_same") | F.coalesce(verdict, F.lit(False)))
    pairs = df.where(open_).select(predicted.alias("_predicted"), gold.alias("_gold")).distinct()
    verdicts = pairs.withColumn("_verdict", verifier(F.col("_predicted"), F.col("_gold")))
    same = (predicted == F.col("_predicted")) & (gold == F.col("_gold"))
    checked = df.where(open_).join(verdicts, same, "left").withColumn("_same", F.coalesce("_verdict", F.lit(False)))
    settled = df.where(~F.coalesce(open_, F.lit(False)))
    return settled.unionByName(checked.select(*[F.col(f"`{c}`") for c in df.columns]))


def _answer_columns(df: DataFrame, text: Column, gold: Column, names: Sequence[str]) -> DataFrame:
    """What the built-in rewards share, one column per step.

    Each is used several times by the next, so Spark keeps the projections apart: every
    box is parsed and every answer normalised once per row, in generated code.
    """
    if not {"accuracy_reward", "format_reward_boxed"} & set(names):
        return df
    boxed = df.withColumn("_boxed", extract_boxed(text))
    if "accuracy_reward" not in names:
        return boxed
    return boxed.withColumn(
        "_candidate", F.coalesce(F.col("_boxed"), last_number(text))
    ).withColumns({"_left": normalise_answer("_candidate"), "_right": normalise_answer(gold)})


def group_advantage(
    df: DataFrame,
    keys: Sequence[str] = GROUP,
    eps: float = 1e-4,
    scale: str = "group",
    batch: Sequence[str] = ("run_id", "step"),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """WIN-1. Add ``advantage``: rewards centred on the group mean and scaled.

    ``scale`` is ``"group"`` (sample deviation of the group), ``"batch"`` (of the whole
    batch) or ``"none"``. Also adds ``group_rows`` and ``_spread``, which the pruning
    operators use to keep working on the same exchange.
    """
    if scale not in ("group", "batch", "none"):
        raise ValueError(f"unknown scale {scale!r}")
    stats = {"group_rows": F.count(F.lit(1)), "_mean": F.avg("reward")}
    if scale == "group":
        stats["_deviation"] = F.stddev_samp("reward")
    rows = df
    if scale == "batch":
        deviations = df.groupBy(*batch).agg(F.stddev_samp("reward").alias("_deviation"))
        rows = lookup(df, deviations, list(batch), hot_rows)
    rows = with_group_stats(rows, list(keys), stats, hot_rows, counted=df)
    centred = F.col("reward") - F.col("_mean")
    if scale != "none":
        centred = centred / (F.coalesce(F.col("_deviation"), F.lit(0.0)) + F.lit(eps))
    return rows.withColumn("advantage", centred).drop("_mean", "_deviation")


def flag_degenerate(
    df: DataFrame,
    keys: Sequence[str] = GROUP,
    tolerance: float = 1e-8,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """WIN-6. Add ``degenerate``: no completion of the group has an advantage.

    ``counted`` is a cheaper frame with the same keys, from which hot keys are found.
    """
    stats = {"_largest": F.max(F.abs("advantage").cast("float"))}
    flagged = with_group_stats(df, list(keys), stats, hot_rows, counted)
    return flagged.withColumn("degenerate", F.col("_largest") <= tolerance).drop("_largest")


def mask_truncated(df: DataFrame, cap: int | Column, tokens: str = "n_tokens") -> DataFrame:
    """FLT-3. Add ``loss_tokens``: 0 for completions that hit the length cap."""
    terminated = F.col(tokens) < as_col(cap)
    return df.withColumn("loss_tokens", F.when(terminated, F.col(tokens)).otherwise(0))
