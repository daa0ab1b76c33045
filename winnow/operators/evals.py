"""Headline accuracies from evaluation payloads. AGG-8, AGG-9, JN-5, SET-1, AGG-15, RPT-8."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import lookup

# Preferred metrics per task, and fallback metric prefixes.
PRIMARY_METRICS = {
    "gsm8k": ("exact_match,flexible-extract", "exact_match,strict-match"),
    "minerva_math": ("math_verify,none", "exact_match,none"),
    "aime24": ("exact_match,none",),
}
FALLBACK_PREFIXES = ("exact_match", "acc", "math_verify")

# Metric values arrive as JSON text; a JSON number or boolean counts as numeric.
_JSON_NUMBER = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$"


def explode_evals(evals: DataFrame) -> DataFrame:
    """One row per run, task and metric, from a ``results`` map of maps of text."""
    tasks = evals.select("run_id", F.explode("results").alias("task", "metrics"))
    return tasks.select("run_id", "task", F.explode("metrics").alias("metric", "value"))


def _preference(task: Column, metric: Column) -> Column:
    """Position in the task's preferred list; later for a fallback metric, else NULL."""
    rank = None
    for name, metrics in PRIMARY_METRICS.items():
        for position, preferred in enumerate(metrics):
            matches = (task == name) & (metric == preferred)
            rank = F.when(matches, position) if rank is None else rank.when(matches, position)
    fallback = F.lit(False)
    for prefix in FALLBACK_PREFIXES:
        fallback |= F.startswith(metric, F.lit(prefix))
    return rank.when(fallback, 1000)


def _numeric(text: Column) -> Column:
    value = F.when(text.rlike(_JSON_NUMBER), text.try_cast("double"))
    return value.when(text == "true", 1.0).when(text == "false", 0.0)


def headline_metric(metrics: DataFrame, keys: Sequence[str] = ("run_id", "task")) -> DataFrame:
    """AGG-8. One accuracy in percent per run and task.

    The first preferred metric that is numeric wins, then the alphabetically first
    fallback metric; a task with neither has no row.
    """
    ranked = metrics.select(
        *keys,
        _numeric(F.col("value")).alias("_value"),
        F.struct(_preference(F.col("task"), F.col("metric")).alias("rank"), "metric").alias("_by"),
    ).where(F.col("_value").isNotNull() & F.col("_by.rank").isNotNull())
    return ranked.groupBy(*keys).agg((100.0 * F.min_by("_value", "_by")).alias("accuracy"))


def collapse_groups(accuracies: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """AGG-9, JN-5. Drop ``parent_child`` tasks whose parent task is present too.

    Every prefix that ends before an underscore is a possible parent, so the prefix
    test becomes an equi-join on (run, task).
    """
    length = F.char_length("task")
    positions = F.filter(
        F.sequence(F.lit(1), length),
        lambda i: F.substr(F.col("task"), i, F.lit(1)) == "_",
    )
    prefixes = F.transform(positions, lambda i: F.substr(F.col("task"), F.lit(1), i - 1))
    candidates = accuracies.where(F.contains("task", F.lit("_"))).select(
        *by, F.col("task").alias("_child"), F.explode(prefixes).alias("task")
    )
    children = (
        candidates.join(accuracies.select(*by, "task"), [*by, "task"], "left_semi")
        .select(*by, F.col("_child").alias("task"))
        .distinct()
    )
    return accuracies.join(children, [*by, "task"], "left_anti")


def summarize_evals(evals: DataFrame) -> DataFrame:
    """AGG-8 and AGG-9 over raw payloads, one row per run and reported task.

    A payload already holds all tasks and metrics of its run, so both steps work on its
    maps and nothing is shuffled. :func:`headline_metric` and :func:`collapse_groups` do
    the same for metrics that arrive in long form.
    """

    def best(task: Column, metrics: Column) -> Column:
        ranked = F.transform(
            F.map_entries(metrics),
            lambda m: F.struct(
                _preference(task, m["key"]).alias("rank"),
                m["key"].alias("metric"),
                _numeric(m["value"]).alias("value"),
            ),
        )
        usable = F.filter(ranked, lambda m: m["rank"].isNotNull() & m["value"].isNotNull())
        return 100.0 * F.array_min(usable)["value"]

    headline = F.map_filter(
        F.transform_values("results", best), lambda _, accuracy: accuracy.isNotNull()
    )
    tasks = F.map_keys("_headline")
    reported = F.map_filter(
        "_headline",
        lambda task, _: ~F.exists(
            tasks, lambda parent: F.startswith(task, F.concat(parent, F.lit("_")))
        ),
    )
    return evals.withColumn("_headline", headline).select(
        "run_id", F.explode(reported).alias("task", "accuracy")
    )


def all_tasks(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """SET-1. Task names of the runs and of the untrained model."""
    return runs.select("task").union(baseline.select("task")).distinct()


def task_names(tasks: DataFrame) -> list[str]:
    """The distinct names in ``task``, sorted: as many as a table has columns."""
    return sorted(r.task for r in tasks.select("task").distinct().collect() if r.task is not None)


def accuracy_pivot(accuracies: DataFrame, tasks: Sequence[str] | None = None) -> DataFrame:
    """AGG-15. One row per run with a column per task, tasks in sorted order.

    Without ``tasks``, every task of the accuracies has a column.
    """
    tasks = task_names(accuracies) if tasks is None else tasks
    return accuracies.groupBy("run_id").pivot("task", sorted(tasks)).agg(F.first("accuracy"))


def accuracy_delta(
    accuracies: DataFrame, reference: DataFrame, keys: Sequence[str] = ("task",)
) -> DataFrame:
    """RPT-8. Accuracy minus a reference accuracy of the same task.

    ``reference`` has one ``accuracy`` per key: the untrained model, or a baseline run.
    """
    base = reference.select(*keys, F.col("accuracy").alias("reference_accuracy"))
    joined = lookup(accuracies, base, list(keys))
    return joined.withColumn("delta", F.col("accuracy") - F.col("reference_accuracy"))
