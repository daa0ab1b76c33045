"""Batch geometry and cost models as columns over a run table. MTH-1..7, MTH-9."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col


def retained(group_size, pruning_rate) -> Column:
    """MTH-1. ``k``: the integer part of ``G * (1 - P)`` in doubles, within [1, G]."""
    size = as_col(group_size)
    share = F.lit(1.0) - as_col(pruning_rate).cast("double")
    return F.least(size, F.greatest(F.lit(1), (size * share).cast("int"))).cast("int")


def allocation_multiplier(group_size, kept, allocate=True) -> Column:
    """MTH-2. ``m = max(1, G div k)``; 1 where allocation is off."""
    ratio = F.floor(as_col(group_size) / as_col(kept)).cast("int")
    return F.when(as_col(allocate), F.greatest(F.lit(1), ratio)).otherwise(1)


def scaled_warmup(base_steps, multiplier) -> Column:
    """MTH-4. Warm-up over the same share of a schedule that is ``m`` times shorter."""
    base, m = as_col(base_steps), as_col(multiplier)
    rounded = F.floor((base + F.floor(m / 2)) / m).cast("int")
    return F.when(base <= 0, 0).otherwise(F.greatest(F.lit(1), rounded))


def amdahl(pruning_rate, update_share) -> Column:
    """MTH-5. Whole-run speedup when only the update share shrinks by ``1 - P``."""
    rate, share = as_col(pruning_rate), as_col(update_share)
    return 1.0 / ((1.0 - share) + share * (1.0 - rate))


def amdahl_ceiling(update_share) -> Column:
    """MTH-5. Limit of the speedup as ``P`` goes to 1; NULL when everything is update."""
    return F.try_divide(F.lit(1.0), 1.0 - as_col(update_share))


def forward_passes(beta, off_policy) -> Column:
    """Forward passes per completion: the policy, a reference model, an old policy."""
    return (
        F.lit(1)
        + (as_col(beta) != 0.0).cast("int")
        + as_col(off_policy).cast("int")
    )


def step_cost(questions, group_size, beta, off_policy, c_gen, c_fwd, c_bwd) -> Column:
    """MTH-6. Rollout plus update cost of one step."""
    completions = as_col(questions) * as_col(group_size)
    update = forward_passes(beta, off_policy) * as_col(c_fwd) + as_col(c_bwd)
    return completions * as_col(c_gen) + completions * update


def unpruned_pass_reasons(beta, generate_every, accumulation, importance_correction) -> Column:
    """MTH-7. Auxiliary passes that still see the unpruned batch."""
    misaligned = F.pmod(as_col(accumulation), as_col(generate_every)) != 0
    return F.array_compact(
        F.array(
            F.when(as_col(beta) != 0.0, "reference-model forward pass"),
            F.when(misaligned, "old-policy forward pass: misaligned generation"),
            F.when(as_col(importance_correction), "old-policy forward pass: importance correction"),
        )
    )
