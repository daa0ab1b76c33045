"""What pruning, rewards and lengths look like per batch. AGG-1..4, AGG-13, AGG-14, AGG-16.

All are two-phase aggregations: partial sums are formed before every exchange, so a hot
run, batch or group costs no more than its share of the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col
from ..functions.rewards import outcome_class
from .scoring import GROUP


def _ratio(numerator: Column, denominator: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(empty))


def summarize_pruning(
    df: DataFrame,
    by: Sequence[str] = ("run_id",),
    group: Sequence[str] = GROUP,
    tolerance: float = 1e-8,
) -> DataFrame:
    """AGG-1. Retention and retained signal of rows marked ``kept``, per batch."""
    magnitude = F.abs("advantage").cast("float").cast("double")
    keys = list(dict.fromkeys([*by, *group]))
    kept = F.col("kept")
    per_group = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"),
        F.count_if(kept).alias("_kept"),
        F.sum(F.when(kept, magnitude).otherwise(0.0)).alias("_mass_kept"),
        F.sum(F.when(kept, 0.0).otherwise(magnitude)).alias("_mass_dropped"),
        F.max(magnitude).alias("_largest"),
    )
    total, kept_rows = F.sum("_total"), F.sum("_kept")
    mass_kept, mass_dropped = F.sum("_mass_kept"), F.sum("_mass_dropped")
    mass = mass_kept + mass_dropped
    return per_group.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_groups"),
        F.max("_total").alias("num_generations"),
        F.max("_kept").alias("num_retained_per_group"),
        total.alias("num_total"),
        kept_rows.alias("num_kept"),
        F.count_if(F.col("_largest") <= tolerance).alias("num_degenerate_groups"),
        _ratio(mass_kept, kept_rows, 0.0).alias("mean_abs_advantage_kept"),
        _ratio(mass_dropped, total - kept_rows, 0.0).alias("mean_abs_advantage_dropped"),
        F.when(mass > 0, mass_kept / mass).otherwise(1.0).alias("retained_signal_fraction"),
    )


def pruning_metrics(summary: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """AGG-2. The logged diagnostics of a pruning summary."""
    at_least_one = lambda name: F.greatest(F.col(name), F.lit(1))
    return summary.select(
        *by,
        (F.col("num_kept") / at_least_one("num_total")).alias("pruning/retention"),
        F.col("retained_signal_fraction").alias("pruning/retained_signal_fraction"),
        F.col("mean_abs_advantage_kept").alias("pruning/abs_advantage_kept"),
        F.col("mean_abs_advantage_dropped").alias("pruning/abs_advantage_dropped"),
        (F.col("num_degenerate_groups") / at_least_one("num_groups")).alias(
            "pruning/frac_degenerate_groups"
        ),
    )


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-6. Prefix every column name but the kept keys."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def num_items(
    df: DataFrame,
    by: Sequence[str] = ("run_id",),
    mask: str = "completion_mask",
    tool_mask: str = "tool_mask",
) -> DataFrame:
    """AGG-3. Loss-carrying tokens of the given (retained) rows.

    A token counts by its completion mask, times its tool mask where there is one.
    """
    add = lambda total, value: total + value
    counted = F.col(mask)
    if tool_mask in df.columns:
        counted = F.when(F.col(tool_mask).isNull(), F.col(mask)).otherwise(
            F.zip_with(F.col(mask), F.col(tool_mask), lambda m, t: m * t)
        )
    tokens = F.aggregate(counted, F.lit(0), lambda total, value: add(total, value.cast("int")))
    return df.groupBy(*by).agg(F.sum(tokens).alias("num_items"))


def stage_timings(events: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """AGG-4. Stage seconds and counts per run.

    ``events`` has ``kind`` (``train_step``, ``rollout`` or ``loss``), ``seconds`` and
    ``completions``. A step includes its rollout, so the update is the difference.
    """
    kind = F.col("kind")

    def total(name: str, of: str) -> Column:
        return F.coalesce(F.sum(F.when(kind == name, F.col(of))), F.lit(0))

    sums = events.groupBy(*by).agg(
        total("train_step", "seconds").cast("double").alias("train_step_seconds"),
        total("rollout", "seconds").cast("double").alias("rollout_seconds"),
        F.count_if(kind == "train_step").alias("train_step_calls"),
        F.count_if(kind == "rollout").alias("rollout_calls"),
        F.count_if(kind == "loss").alias("loss_calls"),
        total("rollout", "completions").alias("completions_generated"),
        total("loss", "completions").alias("completions_updated"),
    )
    return derive_timings(sums)


def derive_timings(sums: DataFrame) -> DataFrame:
    """The derived part of AGG-4, over summed stage columns."""
    update = F.greatest(F.lit(0.0), F.col("train_step_seconds") - F.col("rollout_seconds"))
    return sums.withColumn("update_seconds", update).withColumns(
        {
            "mean_rollout_seconds": _ratio(F.col("rollout_seconds"), F.col("rollout_calls"), 0.0),
            "mean_update_seconds": _ratio(F.col("update_seconds"), F.col("loss_calls"), 0.0),
            "seconds_per_updated_completion": _ratio(
                F.col("update_seconds"), F.col("completions_updated"), 0.0
            ),
            "completion_retention": _ratio(
                F.col("completions_updated"), F.col("completions_generated"), 1.0
            ),
        }
    )


def reward_metrics(
    df: DataFrame, by: Sequence[str] = ("run_id", "step"), group: Sequence[str] = GROUP
) -> DataFrame:
    """AGG-13. Mean and deviation of every reward, and of the groups, per step.

    Groups and steps are two grouping sets of one aggregation, so rows are scored and
    read once; the second aggregation sees one row per group.
    """
    names = [c for c in df.columns if c.startswith("rewards/")]
    keys = list(dict.fromkeys([*by, *group]))
    inner = next(key for key in keys if key not in by)
    values = {"reward": F.avg("reward")}
    for name in names:
        values[f"{name}/mean"] = F.avg(f"`{name}`")
        values[f"{name}/std"] = F.coalesce(F.stddev_samp(f"`{name}`"), F.lit(0.0))
    sets = df.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in by]], *keys).agg(
        F.grouping(inner).alias("_step"),
        F.coalesce(F.stddev_samp("reward"), F.lit(0.0)).alias("_deviation"),
        *[value.alias(name) for name, value in values.items()],
    )
    is_step = F.col("_step") == 1
    deviation = F.when(~is_step, F.col("_deviation"))
    return sets.groupBy(*by).agg(
        *[F.max(F.when(is_step, F.col(f"`{name}`"))).alias(name) for name in values],
        F.avg(deviation).alias("reward_std"),
        F.avg((deviation == 0).cast("double")).alias("frac_reward_zero_std"),
    )


def length_metrics(
    df: DataFrame,
    cap: int | Column,
    by: Sequence[str] = ("run_id", "step"),
    tokens: str = "n_tokens",
) -> DataFrame:
    """AGG-14. Completion lengths, over all and over terminated completions."""
    length = F.col(tokens)
    ended = F.when(length < as_col(cap), length)
    orz = lambda column: F.coalesce(column.cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.min(length).cast("double").alias("completions/min_length"),
        F.avg(length).alias("completions/mean_length"),
        F.max(length).cast("double").alias("completions/max_length"),
        orz(F.min(ended)).alias("completions/min_terminated_length"),
        orz(F.avg(ended)).alias("completions/mean_terminated_length"),
        orz(F.max(ended)).alias("completions/max_terminated_length"),
        (1 - F.count(ended) / F.count(F.lit(1))).alias("completions/clipped_ratio"),
    )


def outcome_mix(
    df: DataFrame,
    format_reward: str = "rewards/format_reward_boxed",
    accuracy: str = "rewards/accuracy_reward",
) -> DataFrame:
    """AGG-16. Rows, mean advantage size and kept share per outcome, with run totals.

    ``level`` is 0 for an outcome of a run, 1 for a run's total and 3 for the total of all, so that a
    run without an id is told from all runs.
    """
    outcome = outcome_class(F.col(f"`{format_reward}`"), F.col(f"`{accuracy}`"))
    return (
        df.withColumn("outcome", outcome)
        .rollup("run_id", "outcome")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("completions"),
            F.avg(F.abs("advantage")).alias("mean_abs_advantage"),
            F.avg(F.col("kept").cast("double")).alias("kept_share"),
        )
    )
