"""Report tables as text cells, and their rendering. RPT-1..7."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col
from ..functions.cells import fixed, latex_escape, percent, plus_minus, times
from ..functions.geometry import allocation_multiplier, amdahl, amdahl_ceiling
from ..functions.text import CLIPPED_RATIO_PATTERN, first_clipped_ratio
from ..operators.evals import accuracy_pivot, all_tasks, task_names
from ..operators.runs import linear_fit, sweep, vs_baseline
from ..operators.skew import lookup

# Headers, placeholders and the length-gate threshold.
PERFORMANCE_HEADERS = (
    "Method", "P", "k", "m", "Steps", "Questions", "Wall clock (s)", "Rollout (s)",
    "Update (s)", "Peak mem (GiB)", "Questions/s", "Throughput gain",
)
BENCHMARK_HEADERS = (
    "P", "k", "Completions/step", "Tokens/step", "Step time (s)",
    "Speedup (pruning only)", "Speedup (with allocation)",
)
NO_RUNS = ("_No training runs available._", r"\emph{No training runs available.}")
NO_EVALS = ("_No evaluation results available._", r"\emph{No evaluation results available.}")
NO_BENCHMARK = (
    "_No update-stage benchmark available._",
    r"\emph{No update-stage benchmark available.}",
)
MAX_CLIPPED_RATIO = 0.5


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def performance_table(
    runs: DataFrame, by: Sequence[str] = ("experiment_id",), order: str = "run_id"
) -> DataFrame:
    """RPT-1. The twelve cells of every run; the gain is against the experiment's first run."""
    compared = vs_baseline(runs, by, order)
    base = F.col("baseline.questions_per_second")
    gain = F.when(base != 0, F.col("questions_per_second") / base)
    cells = (
        F.col("run_name"),
        percent("pruning_rate"),
        _text("num_retained"),
        F.concat(_text("allocation_multiplier"), F.lit("x")),
        _text("optimizer_steps"),
        _text("questions_seen"),
        fixed("wall_clock_seconds", 1),
        fixed("rollout_seconds", 1),
        fixed("update_seconds", 1),
        fixed("peak_memory_gib", 2),
        fixed("questions_per_second", 4),
        times(gain),
    )
    named = [cell.alias(header) for cell, header in zip(cells, PERFORMANCE_HEADERS)]
    keys = list(dict.fromkeys([*by, order]))
    return compared.select(*keys, *named)


def accuracy_table(
    runs: DataFrame,
    accuracies: DataFrame,
    tasks: Sequence[str] | None = None,
    untrained: DataFrame | None = None,
    untrained_name: str = "untrained model",
) -> DataFrame:
    """RPT-2. Accuracy cells per run, with the untrained model's row first.

    ``untrained`` has ``task, accuracy``. The columns are ``tasks``, or the union of the
    tasks of both (SET-1).
    """
    if tasks is None:
        tasks = task_names(accuracies if untrained is None else all_tasks(accuracies, untrained))
    ordered = sorted(tasks)
    wide = accuracy_pivot(accuracies, ordered)
    rows = runs.join(wide, "run_id", "left").select(
        F.lit(False).alias("is_baseline"),
        "run_id",
        F.col("run_name").alias("Method"),
        percent("pruning_rate").alias("P"),
        *[fixed(f"`{task}`").alias(task) for task in ordered],
        fixed("final_reward", 3).alias("Final reward"),
    )
    if untrained is None:
        return rows
    first = untrained.agg(
        *[F.max(F.when(F.col("task") == task, F.col("accuracy"))).alias(task) for task in ordered]
    ).select(
        F.lit(True).alias("is_baseline"),
        F.lit(None).cast(runs.schema["run_id"].dataType).alias("run_id"),
        F.lit(untrained_name).alias("Method"),
        F.lit("--").alias("P"),
        *[fixed(f"`{task}`").alias(task) for task in ordered],
        F.lit("--").alias("Final reward"),
    )
    return first.unionByName(rows)


def allocation_speedup(
    points: DataFrame, by: Sequence[str] = ("bench_id",), x: str = "completions_per_step"
) -> DataFrame:
    """Add the fitted cost, the first point's time and ``allocated_speedup``.

    A refilled step handles ``m`` times the completions, at the cost the fit predicts.
    """
    base = points.groupBy(*by).agg(
        F.min_by("mean_step_seconds", "position").alias("baseline_seconds")
    )
    fits = linear_fit(points, by, x, "mean_step_seconds").join(base, list(by))
    size = F.col("num_generations")
    m = F.when(
        size > 0, allocation_multiplier(size, F.col("num_retained"))
    ).otherwise(1)
    joined = lookup(points, fits, list(by)).withColumn("multiplier", m)
    cost = F.col("intercept") + F.col("slope") * F.col(x) * F.col("multiplier")
    speedup = F.when(cost > 0, F.col("multiplier") * F.col("baseline_seconds") / cost)
    return joined.withColumn("allocated_speedup", F.coalesce(speedup, F.lit(0.0)))


#: The headers of the step micro-benchmark's table; that of ``k`` names the group size.
STEP_HEADERS = ("Pruning rate P", "k", "Completions/step", "Step time (s)", "Peak mem (GiB)", "Speedup")


def benchmark_table(points: DataFrame, by: Sequence[str] = ("bench_id",)) -> DataFrame:
    """RPT-3. Benchmark cells with the measured and the refilled speedup."""
    cells = (
        percent("pruning_rate"),
        _text("num_retained"),
        _text("completions_per_step"),
        _text("tokens_per_step"),
        plus_minus("mean_step_seconds", "stdev_step_seconds"),
        times("speedup"),
        times("allocated_speedup"),
    )
    named = [cell.alias(header) for cell, header in zip(cells, BENCHMARK_HEADERS)]
    return allocation_speedup(points, by).select(*by, "position", *named)


def step_table(points: DataFrame, by: Sequence[str] = ("bench_id",)) -> DataFrame:
    """RPT-6. Cells of the step micro-benchmark's own table, first point first.

    Its formats are plain: four digits without a percent sign, the group size in a header.
    """
    step = F.concat(fixed("mean_step_seconds", 4), F.lit(" \u00b1 "), fixed("stdev_step_seconds", 4))
    cells = (fixed("pruning_rate", 4), _text("num_retained"), _text("completions_per_step"), step,
             fixed("peak_memory_gib", 3), F.concat(fixed("speedup", 2), F.lit("\u00d7")))
    return points.select(*by, "num_generations", "position", *[c.alias(h) for c, h in zip(cells, STEP_HEADERS)])


def step_lines(table: DataFrame, by: Sequence[str] = ("bench_id",)) -> DataFrame:
    """RPT-6. The Markdown lines of every benchmark's step table, as ``by, position, line``."""
    titles = [F.concat(F.lit("k (of G="), _text("num_generations"), F.lit(")")) if h == "k" else F.lit(h) for h in STEP_HEADERS]
    head = table.where("position = 0").select(*by, F.inline(F.array(
        F.struct(F.lit(-2).alias("position"), _piped(titles).alias("line")),
        F.struct(F.lit(-1).alias("position"), F.lit("|" + "---:|" * len(STEP_HEADERS)).alias("line")))))
    body = table.select(*by, F.col("position").cast("int").alias("position"),
                        _piped([F.col(f"`{h}`") for h in STEP_HEADERS]).alias("line"))
    return head.unionByName(body)


def _piped(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def predicted_vs_measured(
    runs: DataFrame, by: Sequence[str] = ("experiment_id",), order: str = "run_id"
) -> DataFrame:
    """RPT-4. Speedup predicted from the baseline's update share of wall clock, and measured.

    ``wall_clock_speedup`` is a ratio of wall clocks, ``throughput_gain`` one of
    questions per second.
    """
    ratio = lambda top, bottom: F.try_divide(F.col(top), F.col(bottom))
    share = ratio("baseline.update_seconds", "baseline.wall_clock_seconds")
    keys = list(dict.fromkeys([*by, order]))
    return vs_baseline(runs, by, order).withColumn("update_share_of_wall", share).select(
        *keys,
        "update_share_of_wall",
        amdahl("pruning_rate", "update_share_of_wall").alias("predicted_speedup"),
        amdahl_ceiling("update_share_of_wall").alias("ceiling"),
        ratio("baseline.wall_clock_seconds", "wall_clock_seconds").alias("wall_clock_speedup"),
        ratio("questions_per_second", "baseline.questions_per_second").alias("throughput_gain"),
        ratio("update_seconds", "baseline.update_seconds").alias("update_ratio"),
        ratio("rollout_seconds", "baseline.rollout_seconds").alias("rollout_ratio"),
    )


def fit_line(points: DataFrame, by: Sequence[str] = ("bench_id",)) -> DataFrame:
    """RPT-5. End points of the fitted step time against ``k``, from 0 to just past G."""
    fits = linear_fit(points, by, "num_retained", "mean_step_seconds")
    widest = points.groupBy(*by).agg(F.max("num_retained").alias("_widest"))
    ends = F.explode(F.array(F.lit(0.0), F.col("_widest") * 1.04)).alias("x")
    lines = fits.join(widest, list(by)).select(*by, "intercept", "slope", "r2", ends)
    return lines.withColumn("y", F.col("intercept") + F.col("slope") * F.col("x"))


def gain_series(points: DataFrame, by: Sequence[str] = ("bench_id",)) -> DataFrame:
    """RPT-5. Measured, refilled and ideal gain per pruning rate; the fit is in ``k``."""
    return allocation_speedup(points, by, "num_retained").select(
        *by,
        "num_retained",
        (100.0 * F.col("pruning_rate")).alias("rate_percent"),
        F.col("speedup").alias("pruning_only"),
        F.col("allocated_speedup").alias("with_allocation"),
        (F.col("num_generations") / F.col("num_retained")).alias("ideal"),
    )


def amdahl_series(shares: DataFrame, share: str = "update_share") -> DataFrame:
    """RPT-5. Predicted speedup at 199 rates, 0 to 0.99, for every share row."""
    return sweep(shares, [i / 200.0 for i in range(199)], share)


def length_gate(ratios: DataFrame, threshold: float = MAX_CLIPPED_RATIO) -> DataFrame:
    """RPT-7. Add ``status``: ``pass`` up to the threshold, ``fail`` above, or ``missing``."""
    ratio = F.col("clipped_ratio")
    status = F.when(ratio.isNull(), "missing").when(ratio > threshold, "fail").otherwise("pass")
    return ratios.withColumn("status", status)


def log_gate(logs: DataFrame, threshold: float = MAX_CLIPPED_RATIO) -> DataFrame:
    """RPT-7 over training logs: the first logged ratio of each."""
    return length_gate(logs.withColumn("clipped_ratio", first_clipped_ratio("value")), threshold)


def scanned_log_gate(lines: DataFrame, threshold: float = MAX_CLIPPED_RATIO) -> DataFrame:
    """RPT-7 over the lines of logs: per ``source_file`` the ratio on the first line that has one.

    ``lines`` comes from ``scan_logs``. Each task hashes its lines down to one number per file
    before the shuffle.
    """
    matches = F.col("value").rlike(CLIPPED_RATIO_PATTERN)
    first = F.min_by(first_clipped_ratio("value"), F.when(matches, F.col("position")))
    return length_gate(lines.groupBy("source_file").agg(first.alias("clipped_ratio")), threshold)


def _row_line(cells: Sequence[str], latex: bool) -> Column:
    values = [F.coalesce(F.col(f"`{cell}`").cast("string"), F.lit("--")) for cell in cells]
    if latex:
        escaped = [latex_escape(value) for value in values]
        return F.concat(F.concat_ws(" & ", *escaped), F.lit(r" \\"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))


def _frame_lines(headers: Sequence[str], latex: bool) -> tuple[list[Column], list[Column]]:
    if not latex:
        heading = F.lit("| " + " | ".join(headers) + " |")
        return [heading, F.lit("|" + "---|" * len(headers))], []
    titles = F.concat_ws(" & ", *[latex_escape(F.lit(header)) for header in headers])
    # A tabular that shrinks to the text width and never grows.
    above = [
        F.lit(r"\resizebox{\ifdim\width>\textwidth\textwidth\else\width\fi}{!}{%"),
        F.lit(r"\begin{tabular}{l" + "r" * (len(headers) - 1) + "}"),
        F.lit(r"\toprule"),
        F.concat(titles, F.lit(r" \\")),
        F.lit(r"\midrule"),
    ]
    return above, [F.lit(r"\bottomrule"), F.lit(r"\end{tabular}"), F.lit("}")]


def render(
    table: DataFrame,
    cells: Sequence[str],
    order: Sequence[str | Column],
    latex: bool = False,
    placeholder: tuple[str, str] = NO_RUNS,
) -> DataFrame:
    """RPT-6. The lines of a Markdown or LaTeX table as ``part, i, key, line``.

    Every row becomes one line where it is; sorting by ``part, key, i`` gives the
    reading order. Only one row is looked at to choose between the frame around the
    table and the placeholder of an empty one.
    """
    above, below = _frame_lines(cells, latex)
    key = F.struct(*[as_col(c).alias(f"o{n}") for n, c in enumerate(order)])
    body = table.select(
        F.lit(1).alias("part"), F.lit(0).alias("i"), key.alias("key"),
        _row_line(cells, latex).alias("line"),
    )
    framed = [(0, n, line) for n, line in enumerate(above)]
    framed += [(2, n, line) for n, line in enumerate(below)]
    missing = [(0, 0, F.lit(placeholder[int(latex)]))]
    rows = table.limit(1).agg(F.count(F.lit(1)).alias("rows"))
    chosen = F.when(F.col("rows") > 0, _lines(framed)).otherwise(_lines(missing))
    frame = rows.select(F.inline(chosen)).withColumn(
        "key", F.lit(None).cast(body.schema["key"].dataType)
    )
    return frame.unionByName(body)


def _lines(lines: Sequence[tuple[int, int, Column]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(part).alias("part"), F.lit(n).alias("i"), line.alias("line"))
            for part, n, line in lines
        ]
    )


def in_order(rendered: DataFrame) -> DataFrame:
    """The lines of a rendered table from top to bottom."""
    return rendered.orderBy("part", "key", "i").select("line")


def render_document(sections: Sequence[tuple[str, DataFrame]], latex: bool = False) -> DataFrame:
    """RPT-6. Rendered tables one after the other, each under its heading."""
    document = None
    for title, rendered in sections:
        if latex:
            heading = r"\subsection*{" + title.replace("%", r"\%") + "}"
        else:
            heading = "### " + title
        around = [(-1, 0, F.lit(heading)), (-1, 1, F.lit("")), (3, 0, F.lit(""))]
        frame = (
            rendered.sparkSession.range(1)
            .select(F.inline(_lines(around)))
            .withColumn("key", F.lit(None).cast(rendered.schema["key"].dataType))
        )
        page = in_order(frame.unionByName(rendered))
        document = page if document is None else document.union(page)
    return document
