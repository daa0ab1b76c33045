"""Declared schemas of rollouts and run artefacts.

``log_history`` entries and evaluation metrics have open key sets, so they are maps and
never inferred structs.
"""

from pyspark.sql import types as T

_long, _int, _double, _text, _bool = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MESSAGES = T.ArrayType(_struct(role=_text, content=_text))

PROBLEM = _struct(problem_id=_long, prompt=_text, solution=_text)

ROLLOUT = _struct(
    run_id=_long, step=_long, group_id=_long, sample_idx=_int, problem_id=_long,
    completion=_text, n_tokens=_int, ts=T.TimestampType(),
)

STAGES = _struct(
    train_step_seconds=_double, rollout_seconds=_double, update_seconds=_double,
    train_step_calls=_long, rollout_calls=_long, loss_calls=_long,
    completions_generated=_long, completions_updated=_long,
    mean_rollout_seconds=_double, mean_update_seconds=_double,
    seconds_per_updated_completion=_double, completion_retention=_double,
)

GEOMETRY = _struct(
    num_generations=_int, num_retained=_int, pruning_rate=_double,
    allocation_multiplier=_int, per_device_train_batch_size=_int,
    gradient_accumulation_steps=_int, num_processes=_int, questions_per_round=_int,
    completions_generated_per_round=_int, completions_updated_per_round=_int,
    update_microbatch_per_device=_double, generation_batch_size=_int,
    update_compute_ratio=_double,
)

PROFILE = _struct(
    run_id=_long, experiment_id=_long, run_name=_text, algorithm=_text, global_step=_long,
    wall_clock_seconds=_double, peak_memory_source=_text,
    peak_memory_allocated_gib=_double, peak_memory_reserved_gib=_double,
    num_train_problems=_long, stages=STAGES, geometry=GEOMETRY,
    settings=T.MapType(_text, _text), environment=T.MapType(_text, _text),
    log_history=T.ArrayType(T.MapType(_text, _double)),
)

POINT = _struct(
    pruning_rate=_double, num_retained=_int, completions_per_step=_long,
    tokens_per_step=_long, mean_step_seconds=_double, stdev_step_seconds=_double,
    peak_memory_gib=_double, peak_reserved_gib=_double, speedup=_double,
)

BENCHMARK = _struct(
    bench_id=_long, model=_text, num_generations=_int, questions=_int,
    completion_length=_int, steps=_int, warmup=_int, device=_text, dtype=_text,
    gradient_checkpointing=_bool, results=T.ArrayType(POINT),
)


def evaluation(summary_field: str) -> T.StructType:
    """Evaluation payload: raw metrics as text, and a summarised accuracy per task."""
    return T.StructType(
        [
            T.StructField("run_id", _long),
            T.StructField("results", T.MapType(_text, T.MapType(_text, _text))),
            T.StructField(summary_field, T.MapType(_text, _double)),
        ]
    )
