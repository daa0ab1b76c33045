"""Rollout-shaped views over the given tables.

The tables hold no rollouts, so these views derive them row by row: every view reads a
whole table and grows with it. The ``*_SQL`` texts state the same views for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BOX
from ..operators.scoring import group_advantage, score

GROUP_SIZE = 8
CAP = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _completion(kind, answer):
    """Eight shapes of model output around an answer."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(kind == 0, text("so ", BOX, answer, "}"))
        .when(kind == 1, text(BOX, "\\frac{", answer, "}{1}}"))
        .when(kind == 2, text(BOX, "9} then ", BOX, answer, "}"))
        .when(kind == 3, text("step 1, so the total is ", answer))
        .when(kind == 4, text(BOX, answer))
        .when(kind == 5, text("<think>\nr</think>\n<answer> ", answer, " </answer>"))
        .when(kind == 6, text(BOX, " ", answer, ".0 }"))
        .otherwise("no digits here")
    )


def _as_rollouts(events: DataFrame, group_id, sample_idx) -> DataFrame:
    answer = (F.col("user_id") % 3).cast("string")
    kind = (F.col("event_id") + F.col("user_id")) % 8
    keyed = events.withColumn("group_id", group_id)
    return keyed.select(
        (F.col("group_id") % 5).alias("run_id"),
        F.expr("group_id div 5 % 10").alias("step"),
        "group_id",
        sample_idx.cast("int").alias("sample_idx"),
        "event_id",
        "ts",
        _completion(kind, answer).alias("completion"),
        (F.col("group_id") % 3).cast("string").alias("solution"),
        (F.col("event_id") * 37 % 1100).cast("int").alias("n_tokens"),
    )


def rollouts_of(events: DataFrame) -> DataFrame:
    return _as_rollouts(events, F.expr("event_id div 8"), F.col("event_id") % 8)


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight consecutive events are the eight completions of one question."""
    return rollouts_of(table(spark, sf_dir, "events"))


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events within 1,200 consecutive ids form a group, of any size."""
    group_id = F.expr("user_id * 100000 + event_id div 1200")
    return _as_rollouts(table(spark, sf_dir, "events"), group_id, F.col("event_id") % 1200)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(rollouts(spark, sf_dir))


def advantaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_advantage(scored(spark, sf_dir))


_ROLLOUT_COLUMNS = """
  select group_id % 5 as run_id, (group_id // 5) % 10 as step, group_id, sample_idx, event_id, ts,
    case kind
      when 0 then 'so ' || chr(92) || 'boxed{' || c || '}'
      when 1 then chr(92) || 'boxed{' || chr(92) || 'frac{' || c || '}{1}}'
      when 2 then chr(92) || 'boxed{9} then ' || chr(92) || 'boxed{' || c || '}'
      when 3 then 'step 1, so the total is ' || c
      when 4 then chr(92) || 'boxed{' || c
      when 5 then '<think>' || chr(10) || 'r</think>' || chr(10) || '<answer> ' || c || ' </answer>'
      when 6 then chr(92) || 'boxed{ ' || c || '.0 }'
      else 'no digits here' end as completion,
    cast(group_id % 3 as varchar) as solution,
    cast(event_id * 37 % 1100 as int) as n_tokens
  from (select *, cast(user_id % 3 as varchar) as c, cast((event_id + user_id) % 8 as int) as kind,
"""
ROLLOUTS_SQL = (
    "rollouts as (" + _ROLLOUT_COLUMNS
    + "event_id // 8 as group_id, cast(event_id % 8 as int) as sample_idx from events) e)"
)
RAGGED_SQL = (
    "ragged as (" + _ROLLOUT_COLUMNS
    + "user_id * 100000 + event_id // 1200 as group_id, cast(event_id % 1200 as int) as sample_idx"
    " from events) e)"
)


# --- the scoring rules in SQL -------------------------------------------------------
# Enough for texts whose boxes nest one level deep; str_1 checks any depth.

_NUM = r"[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?"


def sql_box(c: str) -> str:
    return rf"regexp_extract_all({c}, '\\boxed\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}', 1)[-1]"


def sql_last_number(c: str) -> str:
    return rf"regexp_extract_all({c}, '-?\d+(?:[.,]\d+)?')[-1]"


def sql_candidate(c: str) -> str:
    return f"coalesce({sql_box(c)}, {sql_last_number(c)})"


def sql_normalise(c: str) -> str:
    text = rf"trim(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '$')"
    for noise in ("' '", "','", "chr(92) || '!'", "chr(92) || ','", "chr(92) || '%'"):
        text = f"replace({text}, {noise}, '')"
    text = f"rtrim({text}, '.')"
    return (
        f"case when starts_with({text}, chr(92) || 'text{{') and ends_with({text}, '}}') "
        f"then substr({text}, 7, length({text}) - 7) else {text} end"
    )


def sql_number(c: str) -> str:
    return (
        f"case when regexp_full_match({c}, '{_NUM}') "
        f"then try_cast(replace({c}, '_', '') as double) end"
    )


def sql_rational(c: str) -> str:
    part = lambda pattern, group: sql_number(f"regexp_extract({c}, '{pattern}', {group})")
    quotient, fraction = f"^({_NUM})/({_NUM})$", rf"^([+-]?)\\[dt]?frac\{{({_NUM})\}}\{{({_NUM})\}}$"
    sign = f"case when starts_with({c}, '-') then -1.0 else 1.0 end"
    return (
        f"case when contains({c}, 'frac{{') then ({sign}) * ({part(fraction, 2)}) / "
        f"nullif({part(fraction, 3)}, 0) when contains({c}, '/') then ({part(quotient, 1)}) / "
        f"nullif({part(quotient, 2)}, 0) else {sql_number(c)} end"
    )


def scored_sql(source: str = "rollouts", name: str = "scored") -> str:
    """CTEs that score a rollouts CTE with the boxed rewards."""
    box_count = "(length(completion) - length(replace(completion, chr(92) || 'boxed{', ''))) // 7"
    return f"""
  {name}_a as (select *, {sql_candidate('completion')} as candidate, {sql_box('completion')} as boxed,
      {box_count} as boxes from {source}),
  {name}_b as (select *, {sql_normalise('candidate')} as lft, {sql_normalise('solution')} as rgt
      from {name}_a),
  {name}_c as (select *, coalesce(lft = rgt or abs(({sql_rational('lft')}) - ({sql_rational('rgt')}))
      < 0.000001, false) as correct from {name}_b),
  {name} as (select *, case when correct then 2.0::double else 0.0::double end as acc,
      case when boxes = 1 and boxed is not null then 1.0::double else 0.0::double end as fmt,
      (case when correct then 2.0::double else 0.0::double end)
      + (case when boxes = 1 and boxed is not null then 1.0::double else 0.0::double end) as reward
      from {name}_c)"""


def advantaged_sql(source: str = "scored", name: str = "adv") -> str:
    return f"""
  {name}_w as (select *, count(*) over g as group_rows, avg(reward) over g as mean_r,
      coalesce(stddev_samp(reward) over g, 0) as std_r
      from {source} window g as (partition by run_id, group_id)),
  {name} as (select *, (reward - mean_r) / (std_r + 0.0001::double) as advantage from {name}_w)"""


def ranked_sql(source: str = "adv", name: str = "ranked") -> str:
    return f"""
  {name} as (select *, row_number() over (partition by run_id, group_id
      order by cast(abs(advantage) as float) desc, sample_idx) as rnk from {source})"""


SCORED_SQL = f"with {ROLLOUTS_SQL}, {scored_sql()}"
ADVANTAGE_SQL = f"{SCORED_SQL}, {advantaged_sql()}"
RANKED_SQL = f"{ADVANTAGE_SQL}, {ranked_sql()}"


# --- problems and conversations -----------------------------------------------------

def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        F.col("doc_id").alias("problem_id"),
        F.col("text").alias("prompt"),
        (F.col("doc_id") % 10).cast("string").alias("solution"),
    )


PROBLEMS_SQL = (
    "problems as (select doc_id as problem_id, text as prompt,"
    " cast(doc_id % 10 as varchar) as solution from documents)"
)


def braced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in which common letter groups are turned into boxes and braces."""
    text = F.col("text")
    for plain, mark in (("re", BOX), ("a", "}"), ("u", "{")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


BRACED_SQL = """braced as (select doc_id, replace(replace(replace(text, 're', chr(92) || 'boxed{'),
    'a', '}'), 'u', '{') as text from documents)"""


# --- runs ---------------------------------------------------------------------------

# Fixed grids that reach every edge of the k formula.
SIZES = (4, 5, 8, 10, 16)
RATES = (0.0, 0.4, 0.5, 0.75, 0.8, 0.875, 0.9)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run settings: one run per customer."""
    pick = lambda values, index: F.element_at(F.array(*[F.lit(v) for v in values]), index)
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("run_id"),
        F.col("c_nationkey").cast("bigint").alias("experiment_id"),
        pick(SIZES, (key % 5 + 1).cast("int")).alias("group_size"),
        pick(RATES, (key % 7 + 1).cast("int")).alias("pruning_rate"),
        (F.col("c_nationkey") % 16).alias("base_batch"),
        (1 + key % 8).cast("int").alias("accumulation"),
        (1 + key % 4).cast("int").alias("processes"),
        (key % 3 != 0).alias("allocate"),
        F.when(key % 2 == 0, 0.0).otherwise(0.04).alias("beta"),
        (1 + F.col("c_nationkey") % 4).alias("generate_every"),
        (key % 11 == 0).alias("importance_correction"),
        F.col("c_acctbal").alias("balance"),
    )


def _sql_pick(values, index: str) -> str:
    cases = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"case {index} {cases} end"


RUNS_SQL = f"""runs as (select c_custkey as run_id, cast(c_nationkey as bigint) as experiment_id,
    cast({_sql_pick(SIZES, 'c_custkey % 5')} as int) as group_size,
    cast({_sql_pick(RATES, 'c_custkey % 7')} as double) as pruning_rate,
    c_nationkey % 16 as base_batch, cast(1 + c_custkey % 8 as int) as accumulation,
    cast(1 + c_custkey % 4 as int) as processes, c_custkey % 3 <> 0 as allocate,
    case when c_custkey % 2 = 0 then 0.0::double else 0.04::double end as beta,
    1 + c_nationkey % 4 as generate_every, c_custkey % 11 = 0 as importance_correction,
    c_acctbal as balance from customer)"""

K_SQL = "least(group_size, greatest(1, cast(floor(group_size * (1.0::double - pruning_rate)) as int)))"


# --- run artefacts ------------------------------------------------------------------

def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run profiles: one per order, a customer's orders being one experiment."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    generated = 8 * (100 + key % 900)
    history = F.array(
        F.create_map(F.lit("reward"), price % 3, F.lit("loss"), F.lit(0.5)),
        F.create_map(F.lit("reward"), F.when(key % 4 != 0, price % 2), F.lit("epoch"), F.lit(1.0)),
        F.create_map(F.lit("train_loss"), price),
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("run_id"),
        F.col("o_custkey").alias("experiment_id"),
        F.when(key % 13 != 0, F.concat(F.lit("run_"), key.cast("string"))).alias("run_name"),
        F.when(key % 3 != 0, "pruned").otherwise(F.lit(None)).alias("algorithm"),
        (key % 500).alias("global_step"),
        F.when(key % 17 != 0, price / 16).otherwise(0.0).alias("wall_clock_seconds"),
        (key % 97 / 2).alias("peak_memory_allocated_gib"),
        F.struct(
            (price / 50).alias("rollout_seconds"),
            (price / 100 * (1 + key % 3)).alias("update_seconds"),
            generated.alias("completions_generated"),
            (generated / 4).cast("bigint").alias("completions_updated"),
            F.when(key % 5 != 0, 0.25).alias("completion_retention"),
        ).alias("stages"),
        F.struct(
            F.lit(8).alias("num_generations"),
            (8 - 2 * (key % 4)).cast("int").alias("num_retained"),
            (key % 4 / 4).alias("pruning_rate"),
            F.when(key % 7 != 0, (1 + key % 4).cast("int")).alias("allocation_multiplier"),
        ).alias("geometry"),
        history.alias("log_history"),
    )


SUMMARY_SQL = """summary as (select o_orderkey as run_id, o_custkey as experiment_id,
    case when o_orderkey % 13 <> 0 then 'run_' || o_orderkey else 'unknown' end as run_name,
    case when o_orderkey % 3 <> 0 then 'pruned' else 'GRPO' end as algorithm,
    (o_orderkey % 4) / 4.0::double as pruning_rate,
    cast(8 - 2 * (o_orderkey % 4) as int) as num_retained,
    cast(case when o_orderkey % 7 <> 0 then 1 + o_orderkey % 4 else 1 end as int) as allocation_multiplier,
    o_orderkey % 500 as optimizer_steps,
    case when o_orderkey % 17 <> 0 then o_totalprice / 16 else 0.0::double end as wall_clock_seconds,
    o_totalprice / 50 as rollout_seconds,
    o_totalprice / 100 * (1 + o_orderkey % 3) as update_seconds,
    (o_orderkey % 97) / 2.0::double as peak_memory_gib, 8 as num_generations,
    8 * (100 + o_orderkey % 900) as completions_generated,
    2 * (100 + o_orderkey % 900) as completions_updated,
    case when o_orderkey % 5 <> 0 then 0.25::double else 1.0::double end as retention,
    case when o_orderkey % 4 <> 0 then o_totalprice % 2 else o_totalprice % 3 end as final_reward
    from orders),
  rates as (select *,
    case when rollout_seconds + update_seconds <> 0
      then update_seconds / (rollout_seconds + update_seconds) else 0.0::double end as update_share,
    completions_generated // num_generations as questions_seen,
    case when wall_clock_seconds <> 0
      then (completions_generated // num_generations) / wall_clock_seconds else 0.0::double end
      as questions_per_second from summary)"""


# Fixed names: two known tasks, a subtask, an unknown task, one without a usable metric.
TASKS = ("custom", "gsm8k", "minerva_math", "minerva_math_algebra", "weird")


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation payloads: one per order."""
    key = F.col("o_orderkey")
    value = lambda n: (key * n % 101 / 128).cast("string")
    metrics = lambda *pairs: F.map_filter(
        F.create_map(*[part for name, v in pairs for part in (F.lit(name), v)]),
        lambda _, v: v.isNotNull(),
    )
    some = lambda n, column: F.when(key % n != 0, column)
    results = F.create_map(
        F.lit("gsm8k"),
        metrics(
            ("exact_match,flexible-extract", some(4, value(3))),
            ("exact_match,strict-match", some(5, value(5))),
            ("exact_match_stderr,strict-match", F.lit("N/A")),
            ("alias", F.lit("gsm8k")),
        ),
        F.lit("minerva_math"),
        metrics(("math_verify,none", some(3, value(7))), ("acc,none", some(2, value(11)))),
        F.lit("minerva_math_algebra"), metrics(("exact_match,none", value(13))),
        F.lit("custom"), metrics(("acc,none", value(17)), ("acc_norm,none", value(19))),
        F.lit("weird"), metrics(("stderr,none", value(23))),
    )
    return table(spark, sf_dir, "orders").select(key.alias("run_id"), results.alias("results"))


_METRICS = (
    ("gsm8k", "exact_match,flexible-extract", 3, 4),
    ("gsm8k", "exact_match,strict-match", 5, 5),
    ("minerva_math", "math_verify,none", 7, 3),
    ("minerva_math", "acc,none", 11, 2),
    ("minerva_math_algebra", "exact_match,none", 13, None),
    ("custom", "acc,none", 17, None),
    ("custom", "acc_norm,none", 19, None),
    ("weird", "stderr,none", 23, None),
)
METRICS_SQL = "metrics as (" + " union all ".join(
    f"select o_orderkey as run_id, '{task}' as task, '{metric}' as metric, "
    f"(o_orderkey * {n} % 101) / 128.0::double as value from orders"
    + (f" where o_orderkey % {skip} <> 0" if skip else "")
    for task, metric, n, skip in _METRICS
) + ")"
ACCURACY_SQL = f"""{METRICS_SQL},
  preferred as (select *, case when task = 'gsm8k' and metric = 'exact_match,flexible-extract' then 0
      when task = 'gsm8k' and metric = 'exact_match,strict-match' then 1
      when task = 'minerva_math' and metric = 'math_verify,none' then 0
      when regexp_matches(metric, '^(exact_match|acc|math_verify)') then 9 end as pref from metrics),
  headline as (select run_id, task, 100.0::double * value as accuracy from (select *, row_number()
      over (partition by run_id, task order by pref, metric) as rn from preferred
      where pref is not null) p where rn = 1),
  accuracies as (select * from headline h where not exists (select 1 from headline p
      where p.run_id = h.run_id and p.task <> h.task and starts_with(h.task, p.task || '_')))"""


def bench_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed update steps: ten devices, eight widths each, one row per step."""
    kept = 8 - F.col("event_id") % 8
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 8 % 10").alias("bench_id"),
        kept.cast("int").alias("num_retained"),
        F.expr("event_id div 80").alias("step"),
        (0.05 + kept * 4 / 50 + F.col("value") / 10000).alias("seconds"),
        (F.col("value") / 100).alias("memory_gib"),
    )


SAMPLES_SQL = """samples as (select event_id // 8 % 10 as bench_id, cast(8 - event_id % 8 as int) as num_retained,
    event_id // 80 as step, 0.05::double + (8 - event_id % 8) * 4 / 50.0::double + value / 10000 as seconds,
    value / 100 as memory_gib from events)"""
WARMUP = 2


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark payloads: one per supplier, with points for k = 8, 4, 2, 1."""
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    seconds = lambda k: 0.1 + k * (1 + key % 9) / 60 + (balance * k % 10) / 1000
    points = F.array(
        *[
            F.struct(
                F.lit(1 - k / 8).alias("pruning_rate"),
                F.lit(k).alias("num_retained"),
                F.lit(4 * k).cast("bigint").alias("completions_per_step"),
                F.lit(2048 * k).cast("bigint").alias("tokens_per_step"),
                seconds(k).alias("mean_step_seconds"),
                (key % 7 / 4096).alias("stdev_step_seconds"),
                (key % 5 / 2).alias("peak_memory_gib"),
                (key % 5 / 2).alias("peak_reserved_gib"),
                (seconds(8) / seconds(k)).alias("speedup"),
            )
            for k in (8, 4, 2, 1)
        ]
    )
    return table(spark, sf_dir, "supplier").select(
        key.alias("bench_id"), F.lit(8).alias("num_generations"), points.alias("results")
    )


def benchmark_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = benchmarks(spark, sf_dir)
    points = payload.select(
        "bench_id", "num_generations", F.posexplode("results").alias("position", "point")
    )
    return points.select("bench_id", "num_generations", "position", "point.*")


_SECONDS_SQL = (
    "0.1::double + {k} * (1 + s_suppkey % 9) / 60.0::double + (s_acctbal * {k} % 10) / 1000.0::double"
)
POINTS_SQL = "points as (" + " union all ".join(
    f"select s_suppkey as bench_id, 8 as num_generations, {i} as position, "
    f"{1 - k / 8}::double as pruning_rate, {k} as num_retained, {4 * k}::bigint as completions_per_step, "
    f"{2048 * k}::bigint as tokens_per_step, {_SECONDS_SQL.format(k=k)} as mean_step_seconds, "
    f"(s_suppkey % 7) / 4096.0::double as stdev_step_seconds, "
    f"(s_suppkey % 5) / 2.0::double as peak_memory_gib, "
    f"({_SECONDS_SQL.format(k=8)}) / ({_SECONDS_SQL.format(k=k)}) as speedup from supplier"
    for i, k in enumerate((8, 4, 2, 1))
) + ")"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training logs: one text per order; some never report a clipped ratio."""
    key = F.col("o_orderkey")
    ratio = F.when(key % 4 == 0, "5.0e-01").otherwise((key % 100 / 64).cast("string"))
    line = F.concat(F.lit("{'loss': '0.1', 'completions/clipped_ratio': '"), ratio, F.lit("', "))
    text = F.when(key % 9 == 0, F.lit("{'loss': '0.1'}")).otherwise(
        F.concat(line, F.lit("'step': '1'} {'completions/clipped_ratio': '0.9'}"))
    )
    return table(spark, sf_dir, "orders").select(key.alias("run_id"), text.alias("value"))


LOGS_SQL = """logs as (select o_orderkey as run_id, case when o_orderkey % 9 = 0 then null
    when o_orderkey % 4 = 0 then 0.5::double else (o_orderkey % 100) / 64.0::double end as clipped_ratio
    from orders)"""


def timing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage events of five runs."""
    kind = (
        F.when(F.col("event_type") == "view", "rollout")
        .when(F.col("event_type") == "purchase", "train_step")
        .when(F.col("event_type") == "click", "loss")
        .otherwise("other")
    )
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("run_id"),
        kind.alias("kind"),
        F.col("value").alias("seconds"),
        (F.col("event_id") % 9).alias("completions"),
        "ts",
    )


TIMINGS_SQL = """timing as (select user_id % 5 as run_id, case event_type when 'view' then 'rollout'
    when 'purchase' then 'train_step' when 'click' then 'loss' else 'other' end as kind,
    value as seconds, event_id % 9 as completions, ts from events)"""


# --- logged token log-probabilities ---------------------------------------------------

def logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts with 1 to 6 logged tokens each; every fourth token carries no loss."""
    steps = F.sequence(F.lit(1), (1 + F.col("event_id") % 6).cast("int"))
    array = lambda shift: F.transform(steps, lambda i: -(i + shift) / 8.0)
    keys = ["run_id", "step", "group_id", "sample_idx", "event_id", "group_rows", "_spread", "advantage"]
    return advantaged(spark, sf_dir).select(
        *keys,
        array(F.col("event_id") % 7).alias("logp_new"),
        array(F.col("event_id") % 5).alias("logp_old"),
        array(F.col("event_id") % 3).alias("logp_ref"),
        F.transform(steps, lambda i: (i % 4 != 0).cast("tinyint")).alias("mask"),
    )


LOGPROBS_SQL = f"""{RANKED_SQL},
  tokens as (select *, -(i + event_id % 7) / 8.0::double as lnew, -(i + event_id % 5) / 8.0::double as lold,
      -(i + event_id % 3) / 8.0::double as lref, case when i % 4 <> 0 then 1 else 0 end as m
      from (select *, unnest(range(1, 2 + event_id % 6)) as i from ranked) r),
  ratios as (select *, exp(lnew - lold) as ratio from tokens),
  surrogates as (select run_id, step, group_id, sample_idx, any_value(advantage) as advantage,
      any_value(rnk) as rnk, sum(m) as loss_tokens, count(*) as tokens,
      sum(m * least(ratio * advantage, greatest(0.8::double, least(1.28::double, ratio)) * advantage))
        as surrogate,
      sum(ratio * advantage) as plain,
      sum(m * case when ratio < 0.8::double and advantage < 0 then 1.0::double else 0 end) as clipped_low,
      sum(m * case when ratio > 1.28::double and advantage > 0 then 1.0::double else 0 end) as clipped_high,
      sum(m * (exp(lref - lnew) - (lref - lnew) - 1)) as kl
      from ratios group by run_id, step, group_id, sample_idx)"""
