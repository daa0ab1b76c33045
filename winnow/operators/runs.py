"""Run tables: geometry, checks, summaries, baselines and cost fits.

MTH-3, MTH-7..9, FLT-4, AGG-5..7, AGG-10..12, JN-2, JN-3, JN-7, JN-8, SET-2, SET-3, WIN-10.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col
from ..functions.geometry import allocation_multiplier, amdahl, retained
from .skew import lookup

# The setting names a run may supply.
SETTINGS = (
    "run_name", "output_dir", "seed",
    "model_name_or_path", "torch_dtype", "attn_implementation", "gradient_checkpointing",
    "use_cpu", "use_peft", "lora_r", "lora_alpha", "lora_dropout",
    "dataset_name", "dataset_config", "dataset_split", "prompt_style", "enable_thinking",
    "max_samples", "max_prompt_length", "max_completion_length",
    "num_generations", "temperature", "top_p", "top_k", "use_vllm", "vllm_mode",
    "vllm_gpu_memory_utilization", "vllm_tensor_parallel_size", "vllm_enable_sleep_mode",
    "vllm_importance_sampling_correction",
    "pruning_rate", "dynamic_allocation", "drop_zero_advantage",
    "learning_rate", "lr_scheduler_type", "warmup_steps", "weight_decay", "max_grad_norm",
    "adam_beta1", "adam_beta2", "beta", "epsilon", "epsilon_high", "loss_type",
    "mask_truncated_completions", "scale_rewards", "num_train_epochs", "max_steps",
    "per_device_train_batch_size", "gradient_accumulation_steps",
    "logging_steps", "save_steps", "save_final_model", "report_to", "log_completions",
    "num_completions_to_print", "profile_path",
)

_GEOMETRY_INPUTS = ("group_size", "pruning_rate", "base_batch", "accumulation", "processes")


def violations() -> Column:
    """FLT-4. Broken parameter rules of a run row, as an array of messages."""
    size, rate = F.col("group_size"), F.col("pruning_rate")
    valid = (size > 0) & (rate >= 0) & (rate < 1)
    kept = F.when(valid, retained(size, rate))
    multiplier = F.when(valid, allocation_multiplier(size, kept, F.col("allocate")))
    batch = F.col("base_batch") * multiplier * F.col("processes") * F.col("accumulation")
    missing = [F.when(F.col(c).isNull(), f"{c} is missing") for c in _GEOMETRY_INPUTS]
    return F.array_compact(
        F.array(
            *missing,
            F.when(size <= 0, "group_size must be positive"),
            F.when((rate < 0) | (rate >= 1), "pruning_rate must lie in [0, 1)"),
            F.when(F.col("base_batch") <= 0, "base_batch must be positive"),
            F.when(F.col("accumulation") <= 0, "accumulation must be positive"),
            F.when(F.col("processes") <= 0, "processes must be positive"),
            F.when(F.pmod(batch, F.when(size > 0, size)) != 0,
                   "generation batch is not divisible by group_size"),
        )
    )


def validate_runs(runs: DataFrame, on_invalid: str = "report") -> DataFrame:
    """FLT-4. Add ``violations``, or fail the job on the first broken run."""
    if on_invalid == "report":
        return runs.withColumn("violations", violations())
    message = F.concat(
        F.lit("run "), F.col("run_id").cast("string"), F.lit(": "),
        F.array_join(violations(), "; "),
    )
    broken = F.size(violations()) > 0
    return runs.where(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(True))


def with_geometry(runs: DataFrame, on_invalid: str = "error") -> DataFrame:
    """MTH-3, MTH-9. Add the resolved batch shape of every run.

    Needs ``group_size, pruning_rate, base_batch, accumulation, processes, allocate``.
    ``on_invalid="error"`` fails on a broken run, ``"null"`` leaves its shape NULL.
    """
    if on_invalid == "error":
        checked, usable = validate_runs(runs, "error"), F.lit(True)
    else:
        checked, usable = runs, F.size(violations()) == 0
    size, accumulation = F.col("group_size"), F.col("accumulation")
    shaped = (
        checked.withColumn("_usable", usable)
        .withColumn(
            "num_retained", F.when(F.col("_usable"), retained(size, F.col("pruning_rate")))
        )
        .withColumn(
            "allocation_multiplier",
            F.when(
                F.col("_usable"),
                allocation_multiplier(size, F.col("num_retained"), F.col("allocate")),
            ),
        )
        .withColumn("per_device_batch", F.col("base_batch") * F.col("allocation_multiplier"))
        .withColumn(
            "generation_batch_size",
            F.col("per_device_batch") * F.col("processes") * accumulation,
        )
        .withColumn(
            "questions_per_round", F.floor(F.col("generation_batch_size") / size).cast("int")
        )
    )
    local = F.col("per_device_batch") * accumulation
    local_retained = F.floor(local * F.col("num_retained") / size)
    remainder = F.pmod(local_retained, accumulation).cast("int")
    return shaped.withColumns(
        {
            "completions_generated_per_round": F.col("questions_per_round") * size,
            "completions_updated_per_round": F.col("questions_per_round") * F.col("num_retained"),
            "update_microbatch_per_device": F.col("per_device_batch")
            * F.col("num_retained")
            / size,
            "update_compute_ratio": F.col("num_retained") / size,
            "splits_a_group": F.pmod(local, size) != 0,
            "dropped_per_round": remainder,
        }
    ).drop("_usable")


def default_rates(runs: DataFrame) -> DataFrame:
    """MTH-8. One row per reachable ``k`` from G down to 1, with its pruning rate."""
    exploded = runs.withColumn("k", F.explode(F.sequence(F.col("group_size"), F.lit(1), F.lit(-1))))
    return exploded.withColumn("pruning_rate", 1.0 - F.col("k") / F.col("group_size"))


def sweep(df: DataFrame, rates: Sequence[float], share: str = "update_share") -> DataFrame:
    """JN-8. Every row under every rate of a short list, with its predicted speedup.

    The list is a literal array, so this is a generator and not a cross join.
    """
    grid = df.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return grid.withColumn("speedup", amdahl("rate", share))


def final_reward(history) -> Column:
    """AGG-7. Last logged reward of a history of metric maps, NULL without one."""
    logged = F.filter(as_col(history), lambda entry: entry["reward"].isNotNull())
    return F.try_element_at(logged, F.lit(-1))["reward"]


def final_rewards(log: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """AGG-7 over one row per log entry: the reward at the highest ``position``."""
    logged = log.where(F.col("reward").isNotNull())
    return logged.groupBy(*by).agg(F.max_by("reward", "position").alias("final_reward"))


def _or(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def summarize_runs(profiles: DataFrame) -> DataFrame:
    """AGG-5, AGG-6. One report row per run profile; missing fields take defaults."""
    stage, shape = "stages.", "geometry."
    keys = [c for c in ("run_id", "experiment_id") if c in profiles.columns]
    rows = profiles.select(
        *keys,
        _or("run_name", "unknown").alias("run_name"),
        _or("algorithm", "GRPO").alias("algorithm"),
        _or(shape + "pruning_rate", 0.0).alias("pruning_rate"),
        _or(shape + "num_retained", 0).alias("num_retained"),
        _or(shape + "allocation_multiplier", 1).alias("allocation_multiplier"),
        _or("global_step", 0).alias("optimizer_steps"),
        _or("wall_clock_seconds", 0.0).alias("wall_clock_seconds"),
        _or(stage + "rollout_seconds", 0.0).alias("rollout_seconds"),
        _or(stage + "update_seconds", 0.0).alias("update_seconds"),
        _or("peak_memory_allocated_gib", 0.0).alias("peak_memory_gib"),
        _or(shape + "num_generations", 0).alias("num_generations"),
        _or(stage + "completions_generated", 0).alias("completions_generated"),
        _or(stage + "completions_updated", 0).alias("completions_updated"),
        _or(stage + "completion_retention", 1.0).alias("retention"),
        final_reward("log_history").alias("final_reward"),
    )
    return with_rates(rows)


def with_rates(rows: DataFrame) -> DataFrame:
    """AGG-6. Update share, questions seen and questions per second; 0 when unmeasured."""
    measured = F.col("rollout_seconds") + F.col("update_seconds")
    size = F.col("num_generations")
    share = F.when(measured != 0, F.col("update_seconds") / measured).otherwise(0.0)
    questions = F.when(size > 0, F.floor(F.col("completions_generated") / size)).otherwise(0)
    wall = F.col("wall_clock_seconds")
    return (
        rows.withColumn("update_share", share)
        .withColumn("questions_seen", questions.cast("bigint"))
        .withColumn(
            "questions_per_second",
            F.when(wall != 0, F.col("questions_seen") / wall).otherwise(0.0),
        )
    )


def attach_accuracy(runs: DataFrame, accuracies: DataFrame) -> DataFrame:
    """JN-2. One row per run and task; a run without evaluations keeps one NULL row."""
    return runs.join(accuracies.select("run_id", "task", "accuracy"), "run_id", "left")


def baselines(runs: DataFrame, by: Sequence[str], order: str = "run_id") -> DataFrame:
    """The baseline of each experiment: its first run. One row per experiment."""
    values = [c for c in runs.columns if c not in by]
    first = runs.groupBy(*by).agg(F.min_by(F.struct(*values), F.col(order)).alias("baseline"))
    return first.select(*by, "baseline")


def vs_baseline(
    runs: DataFrame, by: Sequence[str] = ("experiment_id",), order: str = "run_id"
) -> DataFrame:
    """JN-3. Add ``baseline``, the experiment's first run as a struct, to every run."""
    return lookup(runs, baselines(runs, by, order), list(by))


def with_baseline(runs: DataFrame, base: DataFrame) -> DataFrame:
    """SET-2. Baseline rows together with run rows; missing columns are NULL."""
    return base.withColumn("is_baseline", F.lit(True)).unionByName(
        runs.withColumn("is_baseline", F.lit(False)), allowMissingColumns=True
    )


def order_report(df: DataFrame, *keys: str) -> DataFrame:
    """SRT-3. Baseline rows first, then by the given keys."""
    return df.orderBy(F.col("is_baseline").desc(), *keys)


def bench_points(
    samples: DataFrame, warmup: int, by: Sequence[str] = ("bench_id", "num_retained")
) -> DataFrame:
    """AGG-10. Timing over measured steps, peak memory over all steps.

    ``samples`` has one row per timed ``step`` with ``seconds`` and ``memory_gib``.
    """
    seconds = F.when(F.col("step") >= warmup, F.col("seconds"))
    return samples.groupBy(*by).agg(
        F.count(seconds).alias("steps"),
        F.avg(seconds).alias("mean_step_seconds"),
        F.coalesce(F.stddev_samp(seconds), F.lit(0.0)).alias("stdev_step_seconds"),
        F.max("memory_gib").alias("peak_memory_gib"),
    )


def speedups(points: DataFrame, by: Sequence[str] = ("bench_id",)) -> DataFrame:
    """WIN-10. Step time of the unpruned point over each point's step time.

    The baseline has the lowest pruning rate, so the largest ``num_retained``.
    """
    base = points.groupBy(*by).agg(
        F.max_by("mean_step_seconds", "num_retained").alias("baseline_seconds")
    )
    joined = lookup(points, base, list(by))
    return joined.withColumn(
        "speedup", F.try_divide(F.col("baseline_seconds"), F.col("mean_step_seconds"))
    )


def linear_fit(points: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """AGG-11, AGG-12, UDF-4. Least squares ``y = a + b x`` per group.

    One point, or points with a single x, give the constant mean. ``r2`` is 1 where y
    does not vary.
    """
    flat = F.var_pop(y) == 0
    return points.groupBy(*by).agg(
        F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.when(flat, 1.0).otherwise(F.coalesce(F.regr_r2(y, x), F.lit(0.0))).alias("r2"),
    )


def setting_keys(runs: DataFrame, settings: str = "settings") -> DataFrame:
    """One row per run and supplied setting name."""
    return runs.select("run_id", F.explode(F.map_keys(settings)).alias("key"))


def unknown_keys(supplied: DataFrame, known: Sequence[str] = SETTINGS) -> DataFrame:
    """JN-7, SET-3. Supplied setting names that no run accepts.

    The known names are a short fixed list, so the anti join is a literal set test.
    """
    return supplied.where(~F.col("key").isin(*known))
