"""Policy objectives from logged token log-probabilities. OBJ-1..7.

Input rows: ``logp_new``, ``logp_old``, ``logp_ref`` and ``mask`` arrays of one length,
and ``advantage``. Token arrays are reduced inside their row before any exchange, so
only a few numbers per completion are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import retained
from .scoring import GROUP


def _masked_sum(values: Column, mask: str = "mask") -> Column:
    """Sum of a per-token array over loss tokens."""
    counted = F.zip_with(values, F.col(mask), lambda v, m: F.when(m != 0, v).otherwise(0.0))
    return F.aggregate(counted, F.lit(0.0), lambda total, v: total + v)


def _ratios() -> Column:
    return F.zip_with("logp_new", "logp_old", lambda new, old: F.exp(new - old))


def token_surrogate(
    df: DataFrame, eps_low: float = 0.2, eps_high: float = 0.28, beta: float = 0.0
) -> DataFrame:
    """OBJ-1, OBJ-4, OBJ-5. Per completion: clipped surrogate, clip counts and KL.

    Adds ``loss_tokens``, ``surrogate``, ``plain_surrogate``, ``clipped_low``,
    ``clipped_high`` and, only when ``beta`` is not 0, ``kl``.
    """
    a = F.col("advantage")

    def clipped(ratio: Column) -> Column:
        held = F.greatest(F.lit(1.0 - eps_low), F.least(F.lit(1.0 + eps_high), ratio))
        return F.least(ratio * a, held * a)

    ratios = df.withColumn("_ratios", _ratios())
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    rows = ratios.withColumns(
        {
            "loss_tokens": F.aggregate(
                "mask", F.lit(0), lambda total, m: total + F.when(m != 0, 1).otherwise(0)
            ),
            "surrogate": _masked_sum(F.transform("_ratios", clipped)),
            "plain_surrogate": _masked_sum(F.transform("_ratios", lambda r: r * a)),
            "clipped_low": _masked_sum(
                F.transform("_ratios", lambda r: flag((r < 1.0 - eps_low) & (a < 0)))
            ),
            "clipped_high": _masked_sum(
                F.transform("_ratios", lambda r: flag((r > 1.0 + eps_high) & (a > 0)))
            ),
        }
    ).drop("_ratios")
    return kl_penalty(rows, beta) if beta else rows


def kl_penalty(df: DataFrame, beta: float) -> DataFrame:
    """OBJ-4. Add ``kl``, the penalty summed over loss tokens.

    Uses the estimator ``exp(ref - new) - (ref - new) - 1``; with ``beta`` 0 the
    reference log-probabilities are not read at all.
    """
    if beta == 0:
        return df.withColumn("kl", F.lit(0.0))
    gap = F.zip_with("logp_ref", "logp_new", lambda ref, new: ref - new)
    tokens = F.transform(gap, lambda d: F.exp(d) - d - 1.0)
    return df.withColumn("kl", beta * _masked_sum(tokens))


def _per_token(df: DataFrame) -> Column:
    total = F.col("surrogate") - F.col("kl") if "kl" in df.columns else F.col("surrogate")
    return F.coalesce(F.try_divide(total, F.col("loss_tokens")), F.lit(0.0))


def group_objective(
    surrogates: DataFrame, group_size: int, k: int | None = None, keys: Sequence[str] = GROUP
) -> DataFrame:
    """OBJ-2. Mean over completions of the mean over tokens, per group.

    With ``k`` only ``kept`` rows count and the mean is over ``k`` instead of ``G``.
    """
    rows = surrogates if k is None else surrogates.where("kept")
    total = F.sum(_per_token(surrogates))
    return rows.groupBy(*keys).agg((total / (group_size if k is None else k)).alias("objective"))


def dapo_loss(surrogates: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """OBJ-3. Token-normalised loss of the given (retained) rows.

    Surrogate and normaliser come from one aggregation; nothing is joined back.
    """
    tokens = F.sum("loss_tokens")
    total = F.sum(F.col("surrogate") - F.col("kl") if "kl" in surrogates.columns else "surrogate")
    return surrogates.groupBy(*by).agg(
        tokens.alias("num_items"), (-F.try_divide(total, tokens)).alias("loss")
    )


def clip_metrics(
    surrogates: DataFrame, by: Sequence[str] = ("run_id", "step"), part: Sequence[str] = GROUP
) -> DataFrame:
    """OBJ-5. Share of clipped loss tokens per batch, and extremes over its parts."""
    low, high, tokens = F.sum("clipped_low"), F.sum("clipped_high"), F.sum("loss_tokens")
    keys = list(dict.fromkeys([*by, *part]))
    parts = surrogates.groupBy(*keys).agg(
        low.alias("clipped_low"), high.alias("clipped_high"), tokens.alias("loss_tokens")
    )
    share = lambda n: F.coalesce(F.try_divide(n, tokens), F.lit(0.0))
    own = lambda n: F.try_divide(F.col(n), F.col("loss_tokens"))
    return parts.groupBy(*by).agg(
        share(low).alias("clip_ratio/low_mean"),
        F.coalesce(F.min(own("clipped_low")), F.lit(0.0)).alias("clip_ratio/low_min"),
        share(high).alias("clip_ratio/high_mean"),
        F.coalesce(F.max(own("clipped_high")), F.lit(0.0)).alias("clip_ratio/high_max"),
        share(low + high).alias("clip_ratio/region_mean"),
    )


def mean_surrogate(df: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """OBJ-6. ``-mean(ratio * advantage)`` over all tokens, without clipping."""
    summed = F.aggregate(_ratios(), F.lit(0.0), lambda total, r: total + r)
    return df.groupBy(*by).agg(
        (-F.try_divide(F.sum(summed * F.col("advantage")), F.sum(F.size("logp_new")))).alias("loss")
    )


def objective_grid(
    ranked: DataFrame,
    group_size: int,
    rates: Sequence[float],
    by: Sequence[str] = ("run_id",),
    groups: Sequence[str] = GROUP,
) -> DataFrame:
    """OBJ-7. The pruned objective under several rates, from one ranking.

    ``ranked`` has a ``rank`` within the group besides the token sums. Every rate is a
    conditional sum in the same aggregation, so rows are neither copied nor re-ranked.
    """
    kept = lambda rate: retained(F.lit(group_size), F.lit(float(rate)))
    term = _per_token(ranked)
    keys = list(dict.fromkeys([*by, *groups]))
    sums = ranked.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("rank") <= kept(rate), term).otherwise(0.0)).alias(f"_{i}")
            for i, rate in enumerate(rates)
        ]
    )
    means = sums.groupBy(*by).agg(
        *[(F.avg(f"_{i}") / kept(rate)).alias(f"_{i}") for i, rate in enumerate(rates)]
    )
    points = [
        F.struct(
            F.lit(float(rate)).alias("pruning_rate"),
            kept(rate).alias("k"),
            F.col(f"_{i}").alias("objective"),
        )
        for i, rate in enumerate(rates)
    ]
    return means.select(*by, F.inline(F.array(*points)))
