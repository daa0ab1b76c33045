"""Registered queries over run tables, run artefacts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as ce
from ..functions import geometry as geo
from ..functions.text import first_clipped_ratio
from ..operators import diagnostics as dg
from ..operators import evals as ev
from ..operators import runs as rn
from ..sources import readers as rd
from ..sources import writers as wr
from . import report as rp
from . import views as v
from .registry import q6, query, rounded, sql_text

K = v.K_SQL


# --- geometry and cost models -----------------------------------------------------------

@query("mth_1_retained", f"with {v.RUNS_SQL} select run_id, {K} as k from runs")
def mth_1(spark, d):
    return v.runs(spark, d).select("run_id", geo.retained("group_size", "pruning_rate").alias("k"))


_M = f"(case when allocate then greatest(1, group_size // {K}) else 1 end)"


@query("mth_2_allocation_multiplier", f"with {v.RUNS_SQL} select run_id, cast({_M} as int) as m from runs")
def mth_2(spark, d):
    k = geo.retained("group_size", "pruning_rate")
    m = geo.allocation_multiplier("group_size", k, F.col("allocate"))
    return v.runs(spark, d).select("run_id", m.alias("m"))


_VALID = f"base_batch > 0 and (base_batch * {_M} * processes * accumulation) % group_size = 0"
_SHAPE_SQL = f"""with {v.RUNS_SQL}, shaped as (select *, case when {_VALID} then {K} end as k,
    case when {_VALID} then {_M} end as m from runs), sized as (select *, base_batch * m as b,
    base_batch * m * processes * accumulation as gb from shaped)"""


@query("mth_3_with_geometry", f"""{_SHAPE_SQL} select run_id, k as num_retained, cast(m as int) as allocation_multiplier,
    cast(b as int) as per_device_batch, cast(gb as int) as generation_batch_size,
    cast(gb // group_size as int) as questions_per_round,
    cast(gb // group_size * group_size as int) as completions_generated_per_round,
    cast(gb // group_size * k as int) as completions_updated_per_round,
    {q6('b * k / group_size', 'update_microbatch_per_device')},
    {q6('k / group_size', 'update_compute_ratio')} from sized""")
def mth_3(spark, d):
    shaped = rn.with_geometry(v.runs(spark, d), on_invalid="null").select(
        "run_id", "num_retained", "allocation_multiplier", "per_device_batch",
        "generation_batch_size", "questions_per_round", "completions_generated_per_round",
        "completions_updated_per_round", "update_microbatch_per_device", "update_compute_ratio",
    )
    return rounded(shaped, "update_microbatch_per_device", "update_compute_ratio")


@query("mth_9_dropped_remainder", f"""{_SHAPE_SQL} select run_id, (b * accumulation) % group_size <> 0 as splits_a_group,
    cast((b * accumulation * k // group_size) % accumulation as int) as dropped_per_round from sized""")
def mth_9(spark, d):
    shaped = rn.with_geometry(v.runs(spark, d), on_invalid="null")
    return shaped.select("run_id", "splits_a_group", "dropped_per_round")


@query("flt_4_validate_runs", f"""with {v.RUNS_SQL} select run_id, concat_ws('; ',
    case when base_batch <= 0 then 'base_batch must be positive' end,
    case when (base_batch * {_M} * processes * accumulation) % group_size <> 0
    then 'generation batch is not divisible by group_size' end) as violations from runs""")
def flt_4(spark, d):
    checked = rn.validate_runs(v.runs(spark, d))
    return checked.select("run_id", F.array_join("violations", "; ").alias("violations"))


@query("mth_4_scaled_warmup", f"""with {v.RUNS_SQL} select run_id, cast(case when run_id % 12 = 0 then 0
    else greatest(1, (run_id % 12 + {_M} // 2) // {_M}) end as int) as warmup from runs""")
def mth_4(spark, d):
    k = geo.retained("group_size", "pruning_rate")
    m = geo.allocation_multiplier("group_size", k, F.col("allocate"))
    warmup = geo.scaled_warmup(F.col("run_id") % 12, m)
    return v.runs(spark, d).select("run_id", warmup.alias("warmup"))


_SHARE = "(run_id % 100) / 100.0::double"


@query("mth_5_amdahl", f"""with {v.RUNS_SQL} select run_id,
    {q6(f'1 / ((1 - {_SHARE}) + {_SHARE} * (1 - pruning_rate))', 'speedup')},
    {q6(f'1 / (1 - {_SHARE})', 'ceiling')} from runs""")
def mth_5(spark, d):
    share = F.col("run_id") % 100 / 100
    rows = v.runs(spark, d).select(
        "run_id",
        geo.amdahl("pruning_rate", share).alias("speedup"),
        geo.amdahl_ceiling(share).alias("ceiling"),
    )
    return rounded(rows, "speedup", "ceiling")


@query("mth_6_step_cost", f"""with {v.RUNS_SQL} select run_id, {q6('''base_batch * group_size * 2.0::double
    + base_batch * group_size * ((1 + (beta <> 0)::int + importance_correction::int) * 1.5::double + 3.0::double)''',
    'cost')} from runs""")
def mth_6(spark, d):
    cost = geo.step_cost(
        "base_batch", "group_size", "beta", "importance_correction", 2.0, 1.5, 3.0
    )
    return rounded(v.runs(spark, d).select("run_id", cost.alias("cost")), "cost")


@query("mth_7_unpruned_passes", f"""with {v.RUNS_SQL} select run_id, concat_ws('; ',
    case when beta <> 0 then 'reference-model forward pass' end,
    case when accumulation % generate_every <> 0 then 'old-policy forward pass: misaligned generation' end,
    case when importance_correction then 'old-policy forward pass: importance correction' end) as reasons from runs""")
def mth_7(spark, d):
    reasons = geo.unpruned_pass_reasons(
        "beta", "generate_every", "accumulation", "importance_correction"
    )
    return v.runs(spark, d).select("run_id", F.array_join(reasons, "; ").alias("reasons"))


@query("mth_8_default_rates", f"""with {v.RUNS_SQL} select run_id, cast(k as int) as k,
    {q6('1 - k / group_size', 'pruning_rate')} from (select run_id, group_size,
    unnest(range(1, group_size + 1)) as k from runs) r""")
def mth_8(spark, d):
    rates = rn.default_rates(v.runs(spark, d)).select("run_id", "k", "pruning_rate")
    return rounded(rates, "pruning_rate")


@query("jn_8_sweep", f"""with {v.SUMMARY_SQL}, grid as (select run_id, update_share,
    unnest([0.0, 0.25, 0.5, 0.75, 0.875]::double[]) as rate from rates) select run_id, rate,
    {q6('1 / ((1 - update_share) + update_share * (1 - rate))', 'speedup')} from grid""")
def jn_8(spark, d):
    summary = rn.summarize_runs(v.profiles(spark, d)).select("run_id", "update_share")
    grid = rn.sweep(summary, [0.0, 0.25, 0.5, 0.75, 0.875])
    return rounded(grid.select("run_id", "rate", "speedup"), "speedup")


# --- settings ---------------------------------------------------------------------------

def _settings(spark, d):
    names = F.create_map(
        F.lit("num_generations"), F.lit("8"),
        F.concat(F.lit("typo_"), (F.col("p_size") % 3).cast("string")), F.lit("1"),
        F.when(F.col("p_partkey") % 2 == 0, "beta").otherwise("betta"), F.lit("0"),
    )
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("run_id"), names.alias("settings"))


_SUPPLIED_SQL = """supplied as (select p_partkey as run_id, 'num_generations' as key from part union all
    select p_partkey, 'typo_' || p_size % 3 from part union all
    select p_partkey, case when p_partkey % 2 = 0 then 'beta' else 'betta' end from part)"""


@query("jn_7_unknown_keys", f"""with {_SUPPLIED_SQL} select run_id, key from supplied
    where key not in ('num_generations', 'beta')""")
def jn_7(spark, d):
    return rn.unknown_keys(rn.setting_keys(_settings(spark, d)))


@query("set_3_unknown_key_names", f"""with {_SUPPLIED_SQL} select distinct key from supplied except
    select unnest(['num_generations', 'beta'])""")
def set_3(spark, d):
    return rn.unknown_keys(rn.setting_keys(_settings(spark, d)).select("key").distinct())


# --- artefact sources and sinks ---------------------------------------------------------

def _stored_profiles(spark, d):
    path = wr.write_reports(v.profiles(spark, d), wr.scratch_dir(spark, "profiles"))
    return rd.read_profiles(spark, path, whole_files=False)


_SUMMARY_COLUMNS = (
    "run_id", "run_name", "algorithm", "pruning_rate", "num_retained", "allocation_multiplier",
    "optimizer_steps", "num_generations", "completions_generated", "completions_updated",
    "retention", "questions_seen",
)
_SUMMARY_DOUBLES = (
    "wall_clock_seconds", "rollout_seconds", "update_seconds", "peak_memory_gib", "final_reward",
    "update_share", "questions_per_second",
)
_SUMMARY_ORACLE = (
    f"with {v.SUMMARY_SQL} select {', '.join(_SUMMARY_COLUMNS)}, "
    f"{', '.join(q6(c, c) for c in _SUMMARY_DOUBLES)} from rates"
)


def _summary_rows(profiles):
    summary = rn.summarize_runs(profiles).select(*_SUMMARY_COLUMNS, *_SUMMARY_DOUBLES)
    return rounded(summary, *_SUMMARY_DOUBLES)


query("src_3_read_profiles", _SUMMARY_ORACLE)(lambda s, d: _summary_rows(_stored_profiles(s, d)))
query("agg_5_summarize_runs", _SUMMARY_ORACLE)(lambda s, d: _summary_rows(v.profiles(s, d)))


@query("snk_1_write_reports", """select count(*) as reports, count(distinct o_custkey) as experiments from orders""")
def snk_1(spark, d):
    stored = _stored_profiles(spark, d)
    runs = stored.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("runs"))
    return runs.agg(F.sum("runs").alias("reports"), F.count(F.lit(1)).alias("experiments"))


_EVAL_ORACLE = f"with {v.ACCURACY_SQL} select run_id, task, {q6('accuracy', 'accuracy')} from accuracies"


def _summarized(spark, d):
    return ev.summarize_evals(v.evals(spark, d))


@query("src_4_read_evals", _EVAL_ORACLE)
def src_4(spark, d):
    path = wr.write_reports(v.evals(spark, d), wr.scratch_dir(spark, "evals"))
    return rounded(ev.summarize_evals(rd.read_evals(spark, path, whole_files=False)), "accuracy")


@query("src_5_read_benchmarks", f"""with {v.POINTS_SQL} select bench_id, position, num_retained, completions_per_step,
    {q6('mean_step_seconds', 'mean_step_seconds')}, {q6('speedup', 'speedup')} from points""")
def src_5(spark, d):
    path = wr.write_reports(v.benchmarks(spark, d), wr.scratch_dir(spark, "benchmarks"))
    points = rd.read_benchmarks(spark, path, whole_files=False).select(
        "bench_id", "position", "num_retained", "completions_per_step", "mean_step_seconds", "speedup"
    )
    return rounded(points, "mean_step_seconds", "speedup")


@query("src_6_read_logs", f"""with {v.LOGS_SQL} select clipped_ratio, count(*) as logs from logs group by all""")
def src_6(spark, d):
    path = wr.scratch_dir(spark, "logs")
    v.logs(spark, d).select("value").write.text(path)
    logs = rd.read_logs(spark, path, whole_files=False)
    ratios = logs.select(first_clipped_ratio("value").alias("clipped_ratio"))
    return ratios.groupBy("clipped_ratio").agg(F.count(F.lit(1)).alias("logs"))


@query("src_6_scan_logs", f"""with {v.LOGS_SQL}, kept as (select run_id % 7 as log, run_id, clipped_ratio from logs
    where clipped_ratio is not null), firsts as (select log, arg_min(clipped_ratio, run_id) as clipped_ratio
    from kept group by log) select clipped_ratio, case when clipped_ratio > 0.5 then 'fail' else 'pass' end as status,
    count(*) as logs from firsts group by all""")
def src_6_scan(spark, d):
    path = wr.scratch_dir(spark, "scanned")
    named = v.logs(spark, d).select((F.col("run_id") % 7).alias("log"), "run_id", "value")
    ordered = named.repartition("log").sortWithinPartitions("log", "run_id")
    ordered.select("log", "value").write.partitionBy("log").text(path)
    gate = rp.scanned_log_gate(rd.scan_logs(spark, path))
    return gate.groupBy("clipped_ratio", "status").agg(F.count(F.lit(1)).alias("logs"))


@query("snk_3_write_once", """select run_id, count(*) as events from (select user_id % 5 as run_id from events) e
    group by run_id""")
def snk_3(spark, d):
    path = wr.scratch_dir(spark, "once")
    events = v.table(spark, d, "events").withColumn("run_id", F.col("user_id") % 5)
    wr.write_once(events.where("run_id < 3"), path)
    wr.write_once(events, path)
    stored = spark.read.parquet(path)
    counts = stored.groupBy(F.col("run_id").cast("bigint").alias("run_id"))
    return counts.agg(F.count(F.lit(1)).alias("events"))


# --- run summaries ----------------------------------------------------------------------

_DERIVED = ("update_share", "questions_per_second")


@query("agg_6_derived_rates", f"""with {v.SUMMARY_SQL} select run_id, questions_seen,
    {', '.join(q6(c, c) for c in _DERIVED)} from rates""")
def agg_6(spark, d):
    rates = rn.summarize_runs(v.profiles(spark, d)).select("run_id", "questions_seen", *_DERIVED)
    return rounded(rates, *_DERIVED)


@query("agg_7_final_reward", """select user_id as run_id, arg_max(value, event_id) as final_reward
    from events where event_type = 'view' group by user_id""")
def agg_7(spark, d):
    reward = F.when(F.col("event_type") == "view", F.col("value"))
    log = v.table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("position"), reward.alias("reward")
    )
    return rn.final_rewards(log)


@query("agg_8_headline_metric", f"""with {v.ACCURACY_SQL} select run_id, task, {q6('accuracy', 'accuracy')}
    from headline""")
def agg_8(spark, d):
    return rounded(ev.headline_metric(ev.explode_evals(v.evals(spark, d))), "accuracy")


query("agg_9_collapse_groups", _EVAL_ORACLE)(lambda s, d: rounded(_summarized(s, d), "accuracy"))


@query("jn_5_subtasks", f"""with {v.ACCURACY_SQL} select h.run_id, h.task from headline h where exists
    (select 1 from headline p where p.run_id = h.run_id and p.task <> h.task
    and starts_with(h.task, p.task || '_'))""")
def jn_5(spark, d):
    headline = ev.headline_metric(ev.explode_evals(v.evals(spark, d))).select("run_id", "task")
    kept = ev.collapse_groups(headline)
    return headline.join(kept, ["run_id", "task"], "left_anti")


@query("set_1_all_tasks", f"""with {v.ACCURACY_SQL} select distinct task from accuracies union select 'aime24'""")
def set_1(spark, d):
    untrained = v.table(spark, d, "region").select(F.lit("aime24").alias("task"))
    return ev.all_tasks(_summarized(spark, d), untrained)


_TASKS = ("custom", "gsm8k", "minerva_math", "minerva_math_algebra")


@query("agg_15_accuracy_pivot", f"""with {v.ACCURACY_SQL} select run_id, {', '.join(
    q6(f"max(accuracy) filter (task = '{task}')", task) for task in _TASKS)} from accuracies group by run_id""")
def agg_15(spark, d):
    return rounded(ev.accuracy_pivot(_summarized(spark, d), _TASKS), *_TASKS)


@query("jn_2_attach_accuracy", f"""with {v.ACCURACY_SQL}, given as (select * from accuracies where run_id % 3 <> 0)
    select o.o_orderkey as run_id, g.task, {q6('g.accuracy', 'accuracy')} from orders o
    left join given g on g.run_id = o.o_orderkey""")
def jn_2(spark, d):
    runs = rn.summarize_runs(v.profiles(spark, d)).select("run_id")
    given = _summarized(spark, d).where(F.col("run_id") % 3 != 0)
    return rounded(rn.attach_accuracy(runs, given), "accuracy")


_BASELINE_SQL = f"""with {v.SUMMARY_SQL}, compared as (select r.*, b.run_id as baseline_run,
    b.wall_clock_seconds as bw, b.questions_per_second as bq, b.update_seconds as bu, b.rollout_seconds as br
    from rates r join rates b on b.experiment_id = r.experiment_id
    and b.run_id = (select min(run_id) from rates m where m.experiment_id = r.experiment_id))"""


@query("jn_3_vs_baseline", f"""{_BASELINE_SQL} select run_id, experiment_id, baseline_run,
    {q6('bw', 'baseline_wall_clock')} from compared""")
def jn_3(spark, d):
    compared = rn.vs_baseline(rn.summarize_runs(v.profiles(spark, d))).select(
        "run_id", "experiment_id",
        F.col("baseline.run_id").alias("baseline_run"),
        F.col("baseline.wall_clock_seconds").alias("baseline_wall_clock"),
    )
    return rounded(compared, "baseline_wall_clock")


@query("set_2_with_baseline", """select o_orderkey as run_id, 'run' as kind, null::varchar as note,
    false as is_baseline from orders union all select c_custkey, 'base', c_mktsegment, true from customer""")
def set_2(spark, d):
    base = v.table(spark, d, "customer").select(
        F.col("c_custkey").alias("run_id"), F.lit("base").alias("kind"), F.col("c_mktsegment").alias("note")
    )
    runs = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("run").alias("kind"))
    return rn.with_baseline(runs, base)


@query("srt_3_order_report", """select c_custkey as run_id, true as is_baseline from customer union all
    select o_orderkey, false from orders order by 2 desc, 1""")
def srt_3(spark, d):
    base = v.table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))
    runs = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"))
    return rn.order_report(rn.with_baseline(runs, base), "run_id")


# --- benchmarks and fits ----------------------------------------------------------------

_BENCH = ("mean_step_seconds", "stdev_step_seconds", "peak_memory_gib")
_BENCH_SQL = f"""with {v.SAMPLES_SQL}, bench as (select bench_id, num_retained,
    count(*) filter (step >= {v.WARMUP}) as steps, avg(seconds) filter (step >= {v.WARMUP}) as mean_step_seconds,
    coalesce(stddev_samp(seconds) filter (step >= {v.WARMUP}), 0) as stdev_step_seconds,
    max(memory_gib) as peak_memory_gib from samples group by all)"""


@query("agg_10_bench_points", f"""{_BENCH_SQL} select bench_id, num_retained, steps,
    {', '.join(q6(c, c) for c in _BENCH)} from bench""")
def agg_10(spark, d):
    return rounded(rn.bench_points(v.bench_samples(spark, d), v.WARMUP), *_BENCH)


@query("win_10_speedup", f"""{_BENCH_SQL} select bench_id, num_retained, {q6('''first_value(mean_step_seconds) over
    (partition by bench_id order by num_retained desc) / mean_step_seconds''', 'speedup')} from bench""")
def win_10(spark, d):
    points = rn.bench_points(v.bench_samples(spark, d), v.WARMUP)
    return rounded(rn.speedups(points).select("bench_id", "num_retained", "speedup"), "speedup")


def _fit_sql(x: str, y: str) -> str:
    return f"""{q6(f'coalesce(regr_intercept({y}, {x}), avg({y}))', 'intercept')},
    {q6(f'coalesce(regr_slope({y}, {x}), 0)', 'slope')}"""


@query("agg_11_fit_step_cost", f"""with {v.POINTS_SQL} select bench_id,
    {_fit_sql('completions_per_step', 'mean_step_seconds')} from points group by bench_id""")
def agg_11(spark, d):
    fits = rn.linear_fit(
        v.benchmark_points(spark, d), ["bench_id"], "completions_per_step", "mean_step_seconds"
    )
    return rounded(fits.select("bench_id", "intercept", "slope"), "intercept", "slope")


@query("udf_4_fitted_cost", f"""with {v.POINTS_SQL}, fits as (select bench_id,
    regr_intercept(mean_step_seconds, completions_per_step) as a, regr_slope(mean_step_seconds, completions_per_step)
    as b from points group by bench_id) select bench_id, position, {q6('a + b * completions_per_step', 'cost')}
    from points join fits using (bench_id)""")
def udf_4(spark, d):
    fitted = rp.allocation_speedup(v.benchmark_points(spark, d))
    cost = F.col("intercept") + F.col("slope") * F.col("completions_per_step")
    return rounded(fitted.select("bench_id", "position", cost.alias("cost")), "cost")


@query("agg_12_linear_fit", f"""with {v.SAMPLES_SQL} select bench_id, {_fit_sql('num_retained', 'seconds')},
    {q6('case when var_pop(seconds) = 0 then 1 else coalesce(regr_r2(seconds, num_retained), 0) end', 'r2')}
    from samples group by bench_id""")
def agg_12(spark, d):
    fits = rn.linear_fit(v.bench_samples(spark, d), ["bench_id"], "num_retained", "seconds")
    return rounded(fits, "intercept", "slope", "r2")


# --- reports ----------------------------------------------------------------------------

def _f(expression: str, digits: int) -> str:
    return f"coalesce(printf('%.{digits}f', cast({expression} as double)), '--')"


@query("str_14_cell_formats", f"""select l_orderkey, l_linenumber, {_f('l_discount / 3', 4)} as fixed4,
    {_f('l_extendedprice / 7', 0)} as fixed0, {_f('100 * l_tax / 3', 2)} || '%' as share,
    {_f('l_quantity / 8', 2)} || 'x' as factor, {_f('l_extendedprice / 9', 4)} || ' +/- ' || {_f('l_tax', 4)} as spread,
    {_f("case when l_returnflag = 'A' then l_quantity / 16 end", 3)} as optional from lineitem""")
def str_14(spark, d):
    return v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        ce.fixed(F.col("l_discount") / 3, 4).alias("fixed4"),
        ce.fixed(F.col("l_extendedprice") / 7, 0).alias("fixed0"),
        ce.percent(F.col("l_tax") / 3).alias("share"),
        ce.times(F.col("l_quantity") / 8).alias("factor"),
        ce.plus_minus(F.col("l_extendedprice") / 9, "l_tax").alias("spread"),
        ce.fixed(F.when(F.col("l_returnflag") == "A", F.col("l_quantity") / 16), 3).alias("optional"),
    )


def _escape_sql(c: str) -> str:
    steps = [(sql_text(plain), sql_text(replacement)) for plain, replacement in ce.LATEX_ESCAPES]
    for plain, replacement in steps:
        c = f"replace({c}, {plain}, {replacement})"
    return c


@query("str_15_latex_escape", f"""select page_id, {_escape_sql('url')} as url, {_escape_sql('html')} as html
    from pages""")
def str_15(spark, d):
    pages = v.table(spark, d, "pages")
    return pages.select("page_id", ce.latex_escape("url").alias("url"), ce.latex_escape("html").alias("html"))


@query("str_13_first_clipped_ratio", f"with {v.LOGS_SQL} select run_id, clipped_ratio from logs")
def str_13(spark, d):
    return v.logs(spark, d).select("run_id", first_clipped_ratio("value").alias("clipped_ratio"))


_PERFORMANCE_CELLS = f"""run_name as "Method", {_f('100 * pruning_rate', 2)} || '%' as "P",
    cast(num_retained as varchar) as "k", allocation_multiplier || 'x' as "m",
    cast(optimizer_steps as varchar) as "Steps", cast(questions_seen as varchar) as "Questions",
    {_f('wall_clock_seconds', 1)} as "Wall clock (s)", {_f('rollout_seconds', 1)} as "Rollout (s)",
    {_f('update_seconds', 1)} as "Update (s)", {_f('peak_memory_gib', 2)} as "Peak mem (GiB)",
    {_f('questions_per_second', 4)} as "Questions/s",
    {_f('questions_per_second / nullif(bq, 0)', 2)} || 'x' as "Throughput gain\""""


@query("rpt_1_performance_table", f"""{_BASELINE_SQL} select experiment_id, run_id, {_PERFORMANCE_CELLS}
    from compared""")
def rpt_1(spark, d):
    return rp.performance_table(rn.summarize_runs(v.profiles(spark, d)))


_ACCURACY_CELLS = ", ".join(
    f"""coalesce(printf('%.2f', max(accuracy) filter (task = '{task}')), '--') as "{task}\"""" for task in _TASKS
)


@query("rpt_2_accuracy_table", f"""with {v.ACCURACY_SQL}, {v.SUMMARY_SQL} select false as is_baseline, r.run_id,
    r.run_name as "Method", {_f('100 * any_value(pruning_rate)', 2)} || '%' as "P", {_ACCURACY_CELLS},
    {_f('any_value(final_reward)', 3)} as "Final reward" from rates r left join accuracies a using (run_id)
    group by r.run_id, r.run_name
    union all select true, null, 'untrained model', '--', {', '.join(_f(
    f"max(accuracy) filter (task = '{task}')", 2) for task in _TASKS)}, '--' from
    (select task, avg(accuracy) as accuracy from accuracies group by task) u""")
def rpt_2(spark, d):
    accuracies = _summarized(spark, d)
    untrained = accuracies.groupBy("task").agg(F.avg("accuracy").alias("accuracy"))
    return rp.accuracy_table(rn.summarize_runs(v.profiles(spark, d)), accuracies, _TASKS, untrained)


@query("rpt_2_task_union", f"""with {v.ACCURACY_SQL}, {v.SUMMARY_SQL} select false as is_baseline, r.run_id,
    r.run_name as "Method", {_f('100 * any_value(pruning_rate)', 2)} || '%' as "P", {_ACCURACY_CELLS}, '--' as "untold",
    {_f('any_value(final_reward)', 3)} as "Final reward" from rates r left join accuracies a using (run_id)
    group by r.run_id, r.run_name
    union all select true, null, 'untrained model', '--', {', '.join(_f(
    f"max(accuracy) filter (task = '{task}')", 2) for task in _TASKS)}, {_f('max(accuracy)', 2)}, '--' from
    (select task, avg(accuracy) as accuracy from accuracies group by task) u""")
def rpt_2_union(spark, d):
    """The columns come from the data; the untrained model has a task that no run has."""
    accuracies = _summarized(spark, d)
    untrained = accuracies.groupBy("task").agg(F.avg("accuracy").alias("accuracy"))
    best = untrained.agg(F.lit("untold").alias("task"), F.max("accuracy").alias("accuracy"))
    return rp.accuracy_table(rn.summarize_runs(v.profiles(spark, d)), accuracies, None, untrained.unionByName(best))


_ALLOCATED_SQL = f"""with {v.POINTS_SQL}, fits as (select bench_id, regr_intercept(mean_step_seconds, completions_per_step)
    as a, regr_slope(mean_step_seconds, completions_per_step) as b, arg_min(mean_step_seconds, position) as base
    from points group by bench_id), allocated as (select *, greatest(1, num_generations // num_retained) as m,
    a + b * completions_per_step * greatest(1, num_generations // num_retained) as cost
    from points join fits using (bench_id))"""


@query("rpt_3_benchmark_table", f"""{_ALLOCATED_SQL} select bench_id, position, {_f('100 * pruning_rate', 2)} || '%'
    as "P", cast(num_retained as varchar) as "k", cast(completions_per_step as varchar) as "Completions/step",
    cast(tokens_per_step as varchar) as "Tokens/step",
    {_f('mean_step_seconds', 4)} || ' +/- ' || {_f('stdev_step_seconds', 4)} as "Step time (s)",
    {_f('speedup', 2)} || 'x' as "Speedup (pruning only)",
    {_f('case when cost > 0 then m * base / cost else 0 end', 2)} || 'x' as "Speedup (with allocation)"
    from allocated""")
def rpt_3(spark, d):
    return rp.benchmark_table(v.benchmark_points(spark, d))


_COMPARED = {
    "update_share_of_wall": "f", "predicted_speedup": "1 / ((1 - f) + f * (1 - pruning_rate))",
    "ceiling": "1 / nullif(1 - f, 0)", "wall_clock_speedup": "bw / nullif(wall_clock_seconds, 0)",
    "throughput_gain": "questions_per_second / nullif(bq, 0)",
    "update_ratio": "update_seconds / nullif(bu, 0)", "rollout_ratio": "rollout_seconds / nullif(br, 0)",
}


@query("rpt_4_predicted_vs_measured", f"""{_BASELINE_SQL}, shared as (select *, bu / nullif(bw, 0) as f from compared)
    select experiment_id, run_id, {', '.join(q6(e, c) for c, e in _COMPARED.items())} from shared""")
def rpt_4(spark, d):
    compared = rp.predicted_vs_measured(rn.summarize_runs(v.profiles(spark, d)))
    return rounded(compared, *_COMPARED)


@query("rpt_5_fit_line", f"""with {v.POINTS_SQL}, fits as (select bench_id, regr_intercept(mean_step_seconds, num_retained)
    as a, regr_slope(mean_step_seconds, num_retained) as b, regr_r2(mean_step_seconds, num_retained) as r,
    max(num_retained) as w from points group by bench_id), ends as (select *, unnest([0.0::double, w * 1.04::double])
    as x from fits) select bench_id, {q6('a', 'intercept')}, {q6('b', 'slope')}, {q6('r', 'r2')}, {q6('x', 'x')},
    {q6('a + b * x', 'y')} from ends""")
def rpt_5_line(spark, d):
    return rounded(rp.fit_line(v.benchmark_points(spark, d)), "intercept", "slope", "r2", "x", "y")


_GAIN_SQL = _ALLOCATED_SQL.replace("completions_per_step) as", "num_retained) as").replace(
    "completions_per_step)\n    as a", "num_retained)\n    as a").replace("b * completions_per_step", "b * num_retained")


@query("rpt_5_gain_series", f"""{_GAIN_SQL} select bench_id, num_retained, {q6('100 * pruning_rate', 'rate_percent')},
    {q6('speedup', 'pruning_only')}, {q6('case when cost > 0 then m * base / cost else 0 end', 'with_allocation')},
    {q6('num_generations / num_retained', 'ideal')} from allocated""")
def rpt_5_gain(spark, d):
    series = rp.gain_series(v.benchmark_points(spark, d))
    return rounded(series, "rate_percent", "pruning_only", "with_allocation", "ideal")


@query("rpt_5_amdahl_series", """with grid as (select c_custkey as run_id, (c_custkey % 90) / 100.0::double as share,
    unnest(range(0, 199)) / 200.0::double as rate from customer) select run_id, """ + q6("rate", "rate") + """,
    """ + q6("1 / ((1 - share) + share * (1 - rate))", "speedup") + """ from grid""")
def rpt_5_amdahl(spark, d):
    shares = v.table(spark, d, "customer").select(
        F.col("c_custkey").alias("run_id"), (F.col("c_custkey") % 90 / 100).alias("update_share")
    )
    return rounded(rp.amdahl_series(shares).drop("update_share"), "rate", "speedup")


_HEADER = "| " + " | ".join(rp.PERFORMANCE_HEADERS) + " |"
_CELL_LIST = ", ".join(f'"{header}"' for header in rp.PERFORMANCE_HEADERS)


@query("rpt_6_markdown", f"""{_BASELINE_SQL}, cells as (select {_PERFORMANCE_CELLS} from compared)
    select '{_HEADER}' as line union all select '|{'---|' * 12}' union all
    select '| ' || concat_ws(' | ', {_CELL_LIST}) || ' |' from cells""")
def rpt_6(spark, d):
    table = rp.performance_table(rn.summarize_runs(v.profiles(spark, d)))
    return rp.in_order(rp.render(table, rp.PERFORMANCE_HEADERS, ["experiment_id", "run_id"]))


@query("rpt_6_latex", f"""{_BASELINE_SQL}, cells as (select {_PERFORMANCE_CELLS} from compared)
    select '{chr(92)}resizebox{{{chr(92)}ifdim{chr(92)}width>{chr(92)}textwidth{chr(92)}textwidth{chr(92)}else{chr(92)}width{chr(92)}fi}}{{!}}{{%' as line
    union all select '{chr(92)}begin{{tabular}}{{lrrrrrrrrrrr}}' union all select '{chr(92)}toprule'
    union all select '{' & '.join(rp.PERFORMANCE_HEADERS)} {chr(92)}{chr(92)}' union all select '{chr(92)}midrule'
    union all select concat_ws(' & ', {', '.join(_escape_sql(f'"{h}"') for h in rp.PERFORMANCE_HEADERS)})
    || ' {chr(92)}{chr(92)}' from cells
    union all select '{chr(92)}bottomrule' union all select '{chr(92)}end{{tabular}}' union all select '}}'""")
def rpt_6_latex(spark, d):
    table = rp.performance_table(rn.summarize_runs(v.profiles(spark, d)))
    return rp.in_order(rp.render(table, rp.PERFORMANCE_HEADERS, ["experiment_id", "run_id"], latex=True))


@query("rpt_6_document", f"""{_BASELINE_SQL}, cells as (select {_PERFORMANCE_CELLS} from compared)
    select '### Performance' as line union all select '' union all select '{_HEADER}' union all select '|{'---|' * 12}'
    union all select '| ' || concat_ws(' | ', {_CELL_LIST}) || ' |' from cells union all select ''
    union all select '### Nothing' union all select '' union all select '{rp.NO_RUNS[0]}' union all select ''""")
def rpt_6_document(spark, d):
    """A whole document: a table, and a section whose table is empty."""
    table = rp.performance_table(rn.summarize_runs(v.profiles(spark, d)))
    order = ["experiment_id", "run_id"]
    sections = [("Performance", table), ("Nothing", table.where("run_id is null"))]
    return rp.render_document([(title, rp.render(rows, rp.PERFORMANCE_HEADERS, order)) for title, rows in sections])


@query("rpt_6_steps", f"""with {v.POINTS_SQL}, lines as (select bench_id, position,
    '| ' || concat_ws(' | ', {_f('pruning_rate', 4)}, num_retained, completions_per_step, {_f('mean_step_seconds', 4)} || ' ± '
    || {_f('stdev_step_seconds', 4)}, {_f('peak_memory_gib', 3)}, {_f('speedup', 2)} || '×') || ' |' as line from points)
    select bench_id, cast(position as int) as position, line from lines
    union all select distinct bench_id, -2, '| Pruning rate P | k (of G=' || num_generations || ') | Completions/step | '
    || 'Step time (s) | Peak mem (GiB) | Speedup |' from points
    union all select distinct bench_id, -1, '|---:|---:|---:|---:|---:|---:|' from points""")
def rpt_6_steps(spark, d):
    """The step benchmark's own table, per benchmark."""
    return rp.step_lines(rp.step_table(v.benchmark_points(spark, d)))


@query("snk_2_write_text", f"""{_BASELINE_SQL}, cells as (select {_PERFORMANCE_CELLS} from compared)
    select '{_HEADER}' as line union all select '|{'---|' * 12}' union all
    select '| ' || concat_ws(' | ', {_CELL_LIST}) || ' |' from cells""")
def snk_2(spark, d):
    table = rp.performance_table(rn.summarize_runs(v.profiles(spark, d)))
    lines = rp.in_order(rp.render(table, rp.PERFORMANCE_HEADERS, ["experiment_id", "run_id"]))
    path = wr.write_text(lines, wr.scratch_dir(spark, "report"))
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("rpt_7_log_gate", f"""with {v.LOGS_SQL} select run_id, clipped_ratio, case when clipped_ratio is null
    then 'missing' when clipped_ratio > 0.5 then 'fail' else 'pass' end as status from logs""")
def rpt_7(spark, d):
    return rp.log_gate(v.logs(spark, d)).select("run_id", "clipped_ratio", "status")


@query("rpt_7_metric_gate", f"""with {v.ROLLOUTS_SQL}, ratios as (select run_id, step,
    1 - count(*) filter (n_tokens < 500) / count(*) as clipped_ratio from rollouts group by all)
    select run_id, step, {q6('clipped_ratio', 'clipped_ratio')},
    case when clipped_ratio > 0.5 then 'fail' else 'pass' end as status from ratios""")
def rpt_7_metric(spark, d):
    ratios = dg.length_metrics(v.rollouts(spark, d), 500).select(
        "run_id", "step", F.col("`completions/clipped_ratio`").alias("clipped_ratio")
    )
    return rounded(rp.length_gate(ratios), "clipped_ratio")


@query("rpt_8_accuracy_delta", f"""with {v.ACCURACY_SQL}, reference as (select task, max(accuracy) as base
    from accuracies group by task) select run_id, task, {q6('accuracy', 'accuracy')},
    {q6('base', 'reference_accuracy')}, {q6('accuracy - base', 'delta')}
    from accuracies left join reference using (task)""")
def rpt_8(spark, d):
    accuracies = _summarized(spark, d)
    reference = accuracies.groupBy("task").agg(F.max("accuracy").alias("accuracy"))
    delta = ev.accuracy_delta(accuracies, reference)
    return rounded(delta, "accuracy", "reference_accuracy", "delta")
