"""Registered queries over rollouts: scoring, advantages, pruning, objectives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import retained
from ..functions.rewards import (
    accuracy_reward,
    answers_equal,
    answers_equivalent,
    format_reward_boxed,
    format_reward_think_answer,
    outcome_class,
    python_verifier,
    register_reward,
)
from ..operators import diagnostics as dg
from ..operators import objective as ob
from ..operators import pruning as pr
from ..operators.prompts import (
    filter_prompt_length,
    python_tokenizer,
    to_conversation,
)
from ..operators.rounds import assign_microbatches, assign_rounds, cap, shuffle_key, shuffle_rows
from ..operators.scoring import (
    attach_solutions,
    flag_degenerate,
    group_advantage,
    mask_truncated,
    score,
    with_equivalence,
    with_run,
)
from ..operators.skew import group_window
from ..sources.readers import read_clustered, read_problems, read_rollouts, write_clustered, write_rollouts
from ..sources.writers import scratch_dir
from . import views as v
from .registry import q6, query, rounded, sql_text

G, K = v.GROUP_SIZE, 2


# --- problems and prompts -------------------------------------------------------------

@query("src_1_read_problems", f"with {v.PROBLEMS_SQL.replace('doc_id % 10', 'n_chars')} select * from problems")
def src_1(spark, d):
    return read_problems(spark, f"{d}/documents.parquet", "text", "n_chars", "doc_id")


@query("src_2_read_rollouts", f"""with {v.ROLLOUTS_SQL} select run_id, group_id, sample_idx,
    completion, n_tokens from rollouts""")
def src_2(spark, d):
    path = scratch_dir(spark, "rollouts")
    write_rollouts(v.rollouts(spark, d), path)
    stored = read_rollouts(spark, path)
    return stored.select(
        F.col("run_id").cast("bigint").alias("run_id"),
        "group_id", "sample_idx", "completion", "n_tokens",
    )


_CONVERSATION_SQL = f"""with {v.PROBLEMS_SQL}, said as (select problem_id, solution, prompt,
    {sql_text(tx.SYSTEM_PROMPTS['boxed'])} as system from problems)"""


@query("prj_1_to_conversation", f"""{_CONVERSATION_SQL} select problem_id, solution, 2 as messages,
    'system|user' as roles, system as first_content, prompt as last_content from said""")
def prj_1(spark, d):
    prompts = to_conversation(v.problems(spark, d))
    return prompts.select(
        "problem_id", "solution",
        F.size("prompt").alias("messages"),
        F.array_join(F.transform("prompt", lambda m: m["role"]), "|").alias("roles"),
        F.col("prompt")[0]["content"].alias("first_content"),
        F.col("prompt")[1]["content"].alias("last_content"),
    )


@query("prj_2_system_prompt", f"""select item_id, length(prompt) as prompt_chars, md5(prompt) as prompt_md5
    from (select item_id, case when item_id % 2 = 0 then {sql_text(tx.SYSTEM_PROMPTS['boxed'])}
    else {sql_text(tx.SYSTEM_PROMPTS['think_answer'])} end as prompt from benchmark)""")
def prj_2(spark, d):
    style = F.when(F.col("item_id") % 2 == 0, "boxed").otherwise("think_answer")
    prompts = v.table(spark, d, "benchmark").select("item_id", tx.system_prompt(style).alias("p"))
    return prompts.select(
        "item_id",
        F.char_length("p").cast("bigint").alias("prompt_chars"),
        F.md5("p").alias("prompt_md5"),
    )


_RENDERED_SQL = """'<|system|>' || chr(10) || system || '<|end|>' || chr(10) || '<|user|>' || chr(10)
    || prompt || '<|end|>' || chr(10) || '<|assistant|>' || chr(10)"""


@query("prj_3_render_chat", f"""{_CONVERSATION_SQL} select problem_id, {_RENDERED_SQL} as rendered from said""")
def prj_3(spark, d):
    prompts = to_conversation(v.problems(spark, d))
    return prompts.select("problem_id", tx.render_chat("prompt").alias("rendered"))


@query("prj_4_completion_text", """select conv_id, turn, case when role = 'system' then '' else text end as answer
    from conversations""")
def prj_4(spark, d):
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    chat = F.array(
        message(F.lit("user"), F.lit("question")),
        message(F.col("role"), F.when(F.col("role") != "system", F.col("text"))),
    )
    turns = v.table(spark, d, "conversations")
    return turns.select("conv_id", "turn", tx.completion_text(chat).alias("answer"))


@query("prj_5_keep_prompt_and_solution", f"with {v.PROBLEMS_SQL} select problem_id, solution from problems")
def prj_5(spark, d):
    return to_conversation(v.problems(spark, d)).select("problem_id", "solution")


@query("flt_1_prompt_length", f"""{_CONVERSATION_SQL} select problem_id, solution from said
    where len(regexp_extract_all({_RENDERED_SQL}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r\\f]')) <= 640""")
def flt_1(spark, d):
    kept = filter_prompt_length(to_conversation(v.problems(spark, d)), 640)
    return kept.select("problem_id", "solution")


@query("udf_3_tokenizer", f"""{_CONVERSATION_SQL} select problem_id, solution from said
    where length({_RENDERED_SQL}) <= 4000""")
def udf_3(spark, d):
    chars = python_tokenizer(lambda texts: [len(text) for text in texts])
    kept = filter_prompt_length(to_conversation(v.problems(spark, d)), 4000, chars)
    return kept.select("problem_id", "solution")


_ORDER_SQL = "md5('42:' || cast(problem_id as varchar)), problem_id"


@query("srt_1_shuffle", f"""with {v.PROBLEMS_SQL} select problem_id, md5('42:' || cast(problem_id as varchar))
    as shuffle_key from problems order by {_ORDER_SQL}""")
def srt_1(spark, d):
    shuffled = shuffle_rows(v.problems(spark, d), 42, "problem_id")
    return shuffled.select("problem_id", shuffle_key(42, "problem_id").alias("shuffle_key"))


@query("srt_2_cap", f"""with {v.PROBLEMS_SQL} select problem_id, prompt, solution from problems
    order by {_ORDER_SQL} limit 64""")
def srt_2(spark, d):
    return cap(shuffle_rows(v.problems(spark, d), 42, "problem_id"), 64)


# --- answer scoring -------------------------------------------------------------------

@query("str_1_extract_boxed", f"""with {v.BRACED_SQL},
  parts as (select doc_id, unnest(p) as token, generate_subscripts(p, 1) as n from (select doc_id,
      regexp_extract_all(text, '\\\\boxed\\{{|[{{}}]|[^{{}}\\\\]+|\\\\') as p from braced) t),
  placed as (select *, sum(length(token)) over (partition by doc_id order by n) as stop,
      sum(case when token = '}}' then -1 when token = '{{' or length(token) = 7 and starts_with(token, chr(92))
      and ends_with(token, '{{') then 1 else 0 end) over (partition by doc_id order by n) as depth
      from parts),
  openers as (select doc_id, n, depth - 1 as level, stop from placed
      where starts_with(token, chr(92) || 'boxed{{')),
  closers as (select doc_id, n, depth as level, stop - 1 as stop from placed where token = '}}'),
  pairs as (select o.doc_id, o.stop as a, c.stop as b from openers o asof join closers c
      on o.doc_id = c.doc_id and o.level = c.level and o.n <= c.n),
  best as (select doc_id, max(a) as a, arg_max(b, a) as b from pairs group by doc_id)
  select t.doc_id, substr(t.text, cast(b.a + 1 as bigint), cast(b.b - b.a as bigint)) as boxed from braced t left join best b using (doc_id)""")
def str_1(spark, d):
    return v.braced(spark, d).select("doc_id", tx.extract_boxed("text").alias("boxed"))


@query("str_2_count_boxed", f"""with {v.BRACED_SQL} select doc_id,
    cast(len(regexp_extract_all(text, '\\\\boxed\\{{')) as int) as boxes from braced""")
def str_2(spark, d):
    return v.braced(spark, d).select("doc_id", tx.count_boxed("text").alias("boxes"))


@query("str_3_last_number", f"""select doc_id, {v.sql_last_number('text')} as number from documents""")
def str_3(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.last_number("text").alias("number"))


@query("str_4_answer_candidate", f"""with {v.ROLLOUTS_SQL} select group_id, sample_idx,
    {v.sql_candidate('completion')} as candidate from rollouts""")
def str_4(spark, d):
    candidate = tx.answer_candidate("completion").alias("candidate")
    return v.rollouts(spark, d).select("group_id", "sample_idx", candidate)


@query("str_5_normalise_answer", f"""select page_id, {v.sql_normalise('url')} as url,
    {v.sql_normalise("'$ ' || replace(html, 'e', chr(92) || ',') || '. $'")} as html from pages""")
def str_5(spark, d):
    noisy = F.concat(F.lit("$ "), F.replace("html", F.lit("e"), F.lit("\\,")), F.lit(". $"))
    return v.table(spark, d, "pages").select(
        "page_id",
        tx.normalise_answer("url").alias("url"),
        tx.normalise_answer(noisy).alias("html"),
    )


_PAIR_SQL = """pairs as (select o_orderkey, case cast(o_orderkey % 6 as int) when 0 then cast(o_orderkey as varchar)
    when 1 then '$' || o_orderkey || '.0$' when 2 then o_orderkey || '/2'
    when 3 then chr(92) || 'frac{' || o_orderkey || '}{4}' when 4 then o_orderkey || 'e0'
    else 'order ' || o_orderkey end as predicted,
    case cast(o_orderkey % 4 as int) when 0 then cast(o_orderkey as varchar)
    when 1 then cast(o_orderkey / 2.0 as varchar) when 2 then cast(o_orderkey / 4.0 as varchar)
    else 'order' || o_orderkey end as gold from orders),
  cleaned as (select *, """ + v.sql_normalise("predicted") + " as lft, " + v.sql_normalise("gold") + """ as rgt
    from pairs)"""


def _pairs(spark, d):
    key = F.col("o_orderkey")
    text = key.cast("string")
    predicted = (
        F.when(key % 6 == 0, text)
        .when(key % 6 == 1, F.concat(F.lit("$"), text, F.lit(".0$")))
        .when(key % 6 == 2, F.concat(text, F.lit("/2")))
        .when(key % 6 == 3, F.concat(F.lit("\\frac{"), text, F.lit("}{4}")))
        .when(key % 6 == 4, F.concat(text, F.lit("e0")))
        .otherwise(F.concat(F.lit("order "), text))
    )
    gold = (
        F.when(key % 4 == 0, text)
        .when(key % 4 == 1, (key / 2).cast("string"))
        .when(key % 4 == 2, (key / 4).cast("string"))
        .otherwise(F.concat(F.lit("order"), text))
    )
    orders = v.table(spark, d, "orders")
    return orders.select("o_orderkey", predicted.alias("predicted"), gold.alias("gold"))


@query("str_6_answers_equal", f"""with {_PAIR_SQL} select o_orderkey, coalesce(lft = rgt or
    abs(({v.sql_number('lft')}) - ({v.sql_number('rgt')})) < 0.000001, false) as equal from cleaned""")
def str_6(spark, d):
    return _pairs(spark, d).select("o_orderkey", answers_equal("predicted", "gold").alias("equal"))


_EQUIVALENT_SQL = f"""with {_PAIR_SQL} select o_orderkey, coalesce(lft = rgt or
    abs(({v.sql_rational('lft')}) - ({v.sql_rational('rgt')})) < 0.000001, false) as equivalent from cleaned"""


@query("str_7_answers_equivalent", _EQUIVALENT_SQL)
def str_7(spark, d):
    same = answers_equivalent("predicted", "gold").alias("equivalent")
    return _pairs(spark, d).select("o_orderkey", same)


@query("udf_2_verifier", f"""with {_PAIR_SQL} select o_orderkey, length(predicted) = length(gold) or coalesce(lft = rgt
    or abs(({v.sql_rational('lft')}) - ({v.sql_rational('rgt')})) < 0.000001, false) as equivalent from cleaned""")
def udf_2(spark, d):
    same_length = python_verifier(lambda left, right: len(left) == len(right))
    return with_equivalence(_pairs(spark, d), "predicted", "gold", same_length).select("o_orderkey", "equivalent")


@query("str_8_accuracy_reward", f"{v.SCORED_SQL} select group_id, sample_idx, acc as accuracy from scored")
def str_8(spark, d):
    reward = accuracy_reward("completion", F.col("solution")).alias("accuracy")
    return v.rollouts(spark, d).select("group_id", "sample_idx", reward)


@query("str_9_format_reward_boxed", f"{v.SCORED_SQL} select group_id, sample_idx, fmt as format from scored")
def str_9(spark, d):
    reward = format_reward_boxed("completion").alias("format")
    return v.rollouts(spark, d).select("group_id", "sample_idx", reward)


@query("str_10_format_reward_think_answer", f"""with {v.ROLLOUTS_SQL} select group_id, sample_idx,
    case when regexp_matches(completion, '^\\s*<think>.*?</think>\\s*<answer>.*?</answer>\\s*$', 's')
    then 1.0::double else 0.0::double end as format from rollouts""")
def str_10(spark, d):
    reward = format_reward_think_answer("completion").alias("format")
    return v.rollouts(spark, d).select("group_id", "sample_idx", reward)


@query("str_11_score", f"""{v.SCORED_SQL} select run_id, step, acc as accuracy, fmt as format, reward,
    count(*) as completions from scored group by all""")
def str_11(spark, d):
    rows = v.scored(spark, d).select(
        "run_id", "step",
        F.col("`rewards/accuracy_reward`").alias("accuracy"),
        F.col("`rewards/format_reward_boxed`").alias("format"),
        "reward",
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("completions"))


@query("str_12_outcome_class", f"""{v.SCORED_SQL} select case when fmt > 0 and acc > 0 then
    'format+answer: clean positive' when fmt <= 0 and acc <= 0 then 'neither: clean negative'
    when fmt > 0 then 'format only: ambiguous' else 'answer only: ambiguous' end as outcome,
    count(*) as completions from scored group by 1""")
def str_12(spark, d):
    outcome = outcome_class(
        F.col("`rewards/format_reward_boxed`"), F.col("`rewards/accuracy_reward`")
    )
    scored = v.scored(spark, d).groupBy(outcome.alias("outcome"))
    return scored.agg(F.count(F.lit(1)).alias("completions"))


@query("udf_1_reward_registry", f"""with {v.ROLLOUTS_SQL} select group_id, sample_idx,
    length(completion) / 10.0::double as reward from rollouts""")
def udf_1(spark, d):
    register_reward("length_reward", lambda completion, solution: F.char_length(completion) / 10.0)
    scored = score(v.rollouts(spark, d), rewards=["length_reward"])
    return scored.select("group_id", "sample_idx", "reward")


# --- joins ----------------------------------------------------------------------------

@query("jn_1_attach_solutions", f"""with {v.ROLLOUTS_SQL} select r.group_id, r.sample_idx,
    cast(o.o_orderkey % 3 as varchar) as solution from rollouts r left join orders o on o.o_orderkey = r.group_id""")
def jn_1(spark, d):
    answers = v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("problem_id"),
        (F.col("o_orderkey") % 3).cast("string").alias("solution"),
    )
    asked = v.rollouts(spark, d).withColumn("problem_id", F.col("group_id"))
    return attach_solutions(asked, answers).select("group_id", "sample_idx", "solution")


@query("jn_4_with_run", f"""with {v.ROLLOUTS_SQL}, {v.RUNS_SQL}, sized as (select *, {v.K_SQL} as k from runs)
    select r.group_id, r.sample_idx, s.group_size, s.k from rollouts r left join sized s using (run_id)""")
def jn_4(spark, d):
    settings = v.runs(spark, d).select(
        "run_id", "group_size", retained("group_size", "pruning_rate").alias("k")
    )
    return with_run(v.rollouts(spark, d), settings).select("group_id", "sample_idx", "group_size", "k")


@query("jn_6_apply_mask", f"""{v.RANKED_SQL} select r.group_id, r.sample_idx, r.completion
    from rollouts r join ranked k using (group_id, sample_idx) where k.rnk <= {K}""")
def jn_6(spark, d):
    mask = pr.mark_kept(v.advantaged(spark, d), G, K).select("group_id", "sample_idx", "kept")
    kept = pr.apply_mask(v.rollouts(spark, d), mask, ["group_id", "sample_idx"])
    return kept.select("group_id", "sample_idx", "completion")


# --- advantages and pruning -------------------------------------------------------------

@query("win_1_group_advantage", f"""{v.ADVANTAGE_SQL} select run_id, group_id, sample_idx, group_rows,
    {q6('advantage', 'advantage')} from adv""")
def win_1(spark, d):
    rows = v.advantaged(spark, d)
    rows = rows.select("run_id", "group_id", "sample_idx", "group_rows", "advantage")
    return rounded(rows, "advantage")


@query("win_1_batch_scale", f"""{v.SCORED_SQL}, spread as (select run_id, step, stddev_samp(reward) as s from scored
    group by all), mean as (select *, avg(reward) over (partition by run_id, group_id) as mu from scored)
    select m.group_id, m.sample_idx, {q6('(m.reward - m.mu) / (coalesce(s.s, 0) + 0.0001::double)', 'advantage')}
    from mean m join spread s using (run_id, step)""")
def win_1_batch(spark, d):
    rows = group_advantage(v.scored(spark, d), scale="batch")
    return rounded(rows.select("group_id", "sample_idx", "advantage"), "advantage")


def _selector(order: str):
    def build(spark, d):
        kept = pr.select_topk(v.advantaged(spark, d), K, G, order=order)
        return rounded(kept.select("run_id", "group_id", "sample_idx", "advantage"), "advantage")

    return build


query("win_2_select_topk", f"""{v.RANKED_SQL} select run_id, group_id, sample_idx,
    {q6('advantage', 'advantage')} from ranked where rnk <= {K}""")(_selector("abs"))
@query("win_2_topk_by_run", f"""{v.RANKED_SQL} select run_id, group_id, sample_idx,
    {q6('advantage', 'advantage')} from ranked where rnk <= 1 + run_id % 4""")
def win_2_by_run(spark, d):
    """The best completions of each group, as many as its run keeps."""
    best = pr.group_topk(v.advantaged(spark, d), 1 + F.col("run_id") % 4, most=4)
    return rounded(best.select("run_id", "group_id", "sample_idx", "advantage"), "advantage")


query("win_7_signed", f"""{v.ADVANTAGE_SQL} select run_id, group_id, sample_idx, {q6('advantage', 'advantage')}
    from adv qualify row_number() over (partition by run_id, group_id
    order by cast(advantage as float) desc, sample_idx) <= {K}""")(_selector("signed"))
query("win_7_smallest", f"""{v.ADVANTAGE_SQL} select run_id, group_id, sample_idx, {q6('advantage', 'advantage')}
    from adv qualify row_number() over (partition by run_id, group_id
    order by cast(abs(advantage) as float), sample_idx) <= {K}""")(_selector("smallest"))
query("win_7_random", f"""{v.ADVANTAGE_SQL} select run_id, group_id, sample_idx, {q6('advantage', 'advantage')}
    from adv qualify row_number() over (partition by run_id, group_id
    order by md5('0:' || run_id || ':' || group_id || ':' || sample_idx), sample_idx) <= {K}""")(_selector("random"))
query("srt_4_group_topk", f"""{v.RANKED_SQL} select run_id, group_id, sample_idx,
    {q6('advantage', 'advantage')} from ranked where rnk <= 1""")(
    lambda spark, d: rounded(
        pr.select_topk(v.advantaged(spark, d), 1, G).select(
            "run_id", "group_id", "sample_idx", "advantage"
        ),
        "advantage",
    )
)


@query("win_3_drop_zero", f"""{v.RANKED_SQL} select group_id, sample_idx, rnk <= 4 and abs(advantage) > 0.00000001
    as kept from ranked""")
def win_3(spark, d):
    marked = pr.mark_kept(v.advantaged(spark, d), G, 4, drop_zero=True)
    return marked.select("group_id", "sample_idx", "kept")


@query("win_4_batch_fallback", f"""{v.RANKED_SQL}, strict as (select *, rnk <= {K} and abs(advantage) > 0.00000001
    as s from ranked), batch as (select *, bool_or(s) over (partition by group_id) as any_s from strict)
    select group_id, sample_idx, case when any_s then s else rnk <= {K} end as kept from batch""")
def win_4(spark, d):
    marked = pr.mark_kept(v.advantaged(spark, d), G, K, drop_zero=True, batch=["group_id"])
    return marked.select("group_id", "sample_idx", "kept")


@query("win_4_fallback_smallest", f"""{v.ADVANTAGE_SQL}, placed as (select *, row_number() over (partition by
    run_id, group_id order by abs(cast(advantage as float)), sample_idx) as place from adv), strict as (select *,
    place <= {K} and abs(advantage) > 0.00000001 as s from placed), batch as (select *, bool_or(s) over
    (partition by run_id, step) as any_s from strict)
    select group_id, sample_idx, case when any_s then s else place <= {K} end as kept from batch""")
def win_4_smallest(spark, d):
    """Batches of many groups; the smallest advantages are mostly 0, so some batches fall back."""
    marked = pr.mark_kept(v.advantaged(spark, d), G, K, order="smallest", drop_zero=True, batch=["run_id", "step"])
    return marked.select("group_id", "sample_idx", "kept")


@query("win_4_ragged_batch", f"""with {v.RAGGED_SQL}, {v.scored_sql('ragged')}, {v.advantaged_sql()}, {v.ranked_sql()},
    batch as (select *, bool_or(group_rows <> {G}) over (partition by run_id) as any_ragged from ranked)
    select group_id, sample_idx, any_ragged or rnk <= {K} as kept from batch""")
def win_4_ragged(spark, d):
    """A batch with a ragged group is not pruned at all."""
    rows = group_advantage(score(v.ragged(spark, d)))
    marked = pr.mark_kept(rows, G, K, on_ragged="keep_batch", batch=["run_id"])
    return marked.select("group_id", "sample_idx", "kept")


_RAGGED_SQL = f"""with {v.RAGGED_SQL}, {v.scored_sql('ragged')}, {v.advantaged_sql()}, {v.ranked_sql()}"""


@query("win_5_ragged_keep", f"""{_RAGGED_SQL} select group_id, sample_idx, group_rows,
    group_rows <> {G} or rnk <= {K} as kept from ranked""")
def win_5(spark, d):
    rows = group_advantage(score(v.ragged(spark, d)))
    marked = pr.mark_kept(rows, G, K, on_ragged="keep")
    return marked.select("group_id", "sample_idx", "group_rows", "kept")


@query("win_5_ragged_drop", f"""{_RAGGED_SQL} select group_id, sample_idx, {q6('advantage', 'advantage')}
    from ranked where group_rows = {G} and rnk <= {K}""")
def win_5_drop(spark, d):
    rows = group_advantage(score(v.ragged(spark, d)))
    kept = pr.prune(rows, G, K, on_ragged="drop")
    return rounded(kept.select("group_id", "sample_idx", "advantage"), "advantage")


@query("win_6_degenerate", f"""{v.ADVANTAGE_SQL} select group_id, sample_idx,
    max(abs(cast(advantage as float))) over (partition by run_id, group_id) <= 0.00000001 as degenerate from adv""")
def win_6(spark, d):
    flagged = flag_degenerate(v.advantaged(spark, d), counted=v.rollouts(spark, d))
    return flagged.select("group_id", "sample_idx", "degenerate")


@query("flt_2_prune", f"""{v.RANKED_SQL} select run_id, step, group_id, sample_idx, completion, solution, n_tokens,
    acc as accuracy, reward from ranked where rnk <= {K}""")
def flt_2(spark, d):
    kept = pr.prune(v.advantaged(spark, d), G, K)
    return kept.select(
        "run_id", "step", "group_id", "sample_idx", "completion", "solution", "n_tokens",
        F.col("`rewards/accuracy_reward`").alias("accuracy"), "reward",
    )


@query("flt_3_mask_truncated", f"""with {v.ROLLOUTS_SQL} select group_id, sample_idx,
    case when n_tokens < {v.CAP} then n_tokens else 0 end as loss_tokens from rollouts""")
def flt_3(spark, d):
    masked = mask_truncated(v.rollouts(spark, d), v.CAP)
    return masked.select("group_id", "sample_idx", "loss_tokens")


@query("flt_5_evaluation_mode", f"""{v.RANKED_SQL} select group_id, sample_idx, step % 2 = 1 or rnk <= {K} as kept
    from ranked""")
def flt_5(spark, d):
    training = F.col("step") % 2 == 0
    marked = pr.mark_kept(v.advantaged(spark, d), G, K, training=training)
    return marked.select("group_id", "sample_idx", "kept")


# --- diagnostics ------------------------------------------------------------------------

def _summary_sql(kept: str) -> str:
    return f"""marked as (select *, {kept} as kept, cast(cast(abs(advantage) as float) as double) as mag from ranked),
  per_group as (select run_id, group_id, count(*) as n, count(*) filter (kept) as k, max(mag) as top,
      sum(case when kept then mag else 0 end) as mk, sum(case when kept then 0 else mag end) as md
      from marked group by all),
  summary as (select run_id, count(*) as num_groups, max(n) as num_generations, max(k) as num_retained_per_group,
      cast(sum(n) as bigint) as num_total, cast(sum(k) as bigint) as num_kept,
      count(*) filter (top <= 0.00000001) as num_degenerate_groups,
      coalesce(sum(mk) / nullif(sum(k), 0), 0) as mean_abs_advantage_kept,
      coalesce(sum(md) / nullif(sum(n) - sum(k), 0), 0) as mean_abs_advantage_dropped,
      case when sum(mk) + sum(md) > 0 then sum(mk) / (sum(mk) + sum(md)) else 1 end as retained_signal_fraction
      from per_group group by run_id)"""


_MEANS = ("mean_abs_advantage_kept", "mean_abs_advantage_dropped", "retained_signal_fraction")
SUMMARY_ORACLE = f"""{v.RANKED_SQL}, {_summary_sql(f'rnk <= {K}')} select run_id, num_groups, num_generations,
    num_retained_per_group, num_total, num_kept, num_degenerate_groups,
    {', '.join(q6(m, m) for m in _MEANS)} from summary"""


def _summary(spark, d):
    return dg.summarize_pruning(pr.mark_kept(v.advantaged(spark, d), G, K))


@query("agg_1_summarize_pruning", SUMMARY_ORACLE)
def agg_1(spark, d):
    return rounded(_summary(spark, d), *_MEANS)


@query("src_2_clustered_summary", SUMMARY_ORACLE)
def src_2_clustered(spark, d):
    """The pruning summary over rollouts that lie in buckets of their groups: no shuffle by group."""
    path = scratch_dir(spark, "clustered")
    write_clustered(v.scored(spark, d), path, 8)
    marked = pr.mark_kept(group_advantage(read_clustered(spark, path)), G, K)
    return rounded(dg.summarize_pruning(marked), *_MEANS)


_METRIC_SQL = ", ".join((
    q6("num_kept / greatest(num_total, 1)", "pruning/retention"),
    q6("retained_signal_fraction", "pruning/retained_signal_fraction"),
    q6("mean_abs_advantage_kept", "pruning/abs_advantage_kept"),
    q6("mean_abs_advantage_dropped", "pruning/abs_advantage_dropped"),
    q6("num_degenerate_groups / greatest(num_groups, 1)", "pruning/frac_degenerate_groups"),
))


@query("agg_2_pruning_metrics", f"""{v.RANKED_SQL}, {_summary_sql(f'rnk <= {K}')}
    select run_id, {_METRIC_SQL} from summary""")
def agg_2(spark, d):
    metrics = dg.pruning_metrics(_summary(spark, d))
    return rounded(metrics, *[c for c in metrics.columns if c != "run_id"])


@query("prj_6_prefix_columns", f"""{v.RANKED_SQL}, {_summary_sql(f'rnk <= {K}')} select run_id,
    num_total as "train/num_total", num_kept as "train/num_kept" from summary""")
def prj_6(spark, d):
    summary = _summary(spark, d).select("run_id", "num_total", "num_kept")
    return dg.prefix_columns(summary, "train/", keep=["run_id"])


@query("agg_3_num_items", f"""{v.RANKED_SQL}, kept as (select run_id, unnest(range(1, 2 + event_id % 6)) as i,
    event_id from ranked where rnk <= {K}) select run_id, cast(sum(case when i % 4 <> 0 and
    (event_id % 3 = 0 or i % 3 <> 0) then 1 else 0 end) as bigint) as num_items from kept group by run_id""")
def agg_3(spark, d):
    rows = v.logprobs(spark, d).withColumnRenamed("mask", "completion_mask")
    steps = F.sequence(F.lit(1), F.size("completion_mask"))
    tool = F.transform(steps, lambda i: (i % 3 != 0).cast("tinyint"))
    rows = rows.withColumn("tool_mask", F.when(F.col("event_id") % 3 != 0, tool))
    return dg.num_items(pr.prune(rows, G, K))


@query("agg_4_stage_timings", f"""with {v.TIMINGS_SQL}, sums as (select run_id,
    coalesce(sum(seconds) filter (kind = 'train_step'), 0) as ts, coalesce(sum(seconds) filter (kind = 'rollout'), 0)
    as rs, count(*) filter (kind = 'train_step') as train_step_calls, count(*) filter (kind = 'rollout') as rollout_calls,
    count(*) filter (kind = 'loss') as loss_calls,
    cast(coalesce(sum(completions) filter (kind = 'rollout'), 0) as bigint) as completions_generated,
    cast(coalesce(sum(completions) filter (kind = 'loss'), 0) as bigint) as completions_updated
    from timing group by run_id), up as (select *, greatest(0, ts - rs) as us from sums)
    select run_id, train_step_calls, rollout_calls, loss_calls, completions_generated, completions_updated,
    {q6('ts', 'train_step_seconds')}, {q6('rs', 'rollout_seconds')}, {q6('us', 'update_seconds')},
    {q6('coalesce(rs / nullif(rollout_calls, 0), 0)', 'mean_rollout_seconds')},
    {q6('coalesce(us / nullif(loss_calls, 0), 0)', 'mean_update_seconds')},
    {q6('coalesce(us / nullif(completions_updated, 0), 0)', 'seconds_per_updated_completion')},
    {q6('coalesce(completions_updated / nullif(completions_generated, 0), 1)', 'completion_retention')} from up""")
def agg_4(spark, d):
    timings = dg.stage_timings(v.timing_events(spark, d))
    return rounded(
        timings, "train_step_seconds", "rollout_seconds", "update_seconds", "mean_rollout_seconds",
        "mean_update_seconds", "seconds_per_updated_completion", "completion_retention",
    )


_REWARD_METRICS = ("reward", "reward_std", "frac_reward_zero_std")
_NAMES = {"acc": "rewards/accuracy_reward", "fmt": "rewards/format_reward_boxed"}


@query("agg_13_reward_metrics", f"""{v.SCORED_SQL}, per_group as (select run_id, step, group_id,
    coalesce(stddev_samp(reward), 0) as dev from scored group by all), groups as (select run_id, step,
    avg(dev) as reward_std, avg(case when dev = 0 then 1 else 0 end) as zero from per_group group by all),
    per_row as (select run_id, step, avg(acc) as am, coalesce(stddev_samp(acc), 0) as asd, avg(fmt) as fm,
    coalesce(stddev_samp(fmt), 0) as fsd, avg(reward) as rm from scored group by all)
    select run_id, step, {q6('am', 'rewards/accuracy_reward/mean')}, {q6('asd', 'rewards/accuracy_reward/std')},
    {q6('fm', 'rewards/format_reward_boxed/mean')}, {q6('fsd', 'rewards/format_reward_boxed/std')},
    {q6('rm', 'reward')}, {q6('reward_std', 'reward_std')}, {q6('zero', 'frac_reward_zero_std')}
    from per_row join groups using (run_id, step)""")
def agg_13(spark, d):
    metrics = dg.reward_metrics(v.scored(spark, d))
    return rounded(metrics, *[c for c in metrics.columns if c not in ("run_id", "step")])


def _length_sql(prefix: str, value: str) -> str:
    return ", ".join(
        q6(f"coalesce({f}({value}), 0)", f"completions/{f.replace('avg', 'mean')}_{prefix}length")
        for f in ("min", "avg", "max")
    )


@query("agg_14_length_metrics", f"""with {v.ROLLOUTS_SQL}, ended as (select *, case when n_tokens < {v.CAP}
    then n_tokens end as e from rollouts) select run_id, step, {_length_sql('', 'n_tokens')},
    {_length_sql('terminated_', 'e')}, {q6('1 - count(e) / count(*)', 'completions/clipped_ratio')}
    from ended group by run_id, step""")
def agg_14(spark, d):
    metrics = dg.length_metrics(v.rollouts(spark, d), v.CAP)
    return rounded(metrics, *[c for c in metrics.columns if c not in ("run_id", "step")])


@query("agg_16_outcome_mix", f"""{v.RANKED_SQL}, classed as (select *, case when fmt > 0 and acc > 0 then
    'format+answer: clean positive' when fmt <= 0 and acc <= 0 then 'neither: clean negative'
    when fmt > 0 then 'format only: ambiguous' else 'answer only: ambiguous' end as outcome from ranked)
    select run_id, outcome, cast(grouping_id(run_id, outcome) as int) as level, count(*) as completions,
    {q6('avg(abs(advantage))', 'mean_abs_advantage')}, {q6(f'avg(case when rnk <= {K} then 1 else 0 end)', 'kept_share')}
    from classed group by rollup (run_id, outcome)""")
def agg_16(spark, d):
    mix = dg.outcome_mix(pr.mark_kept(v.advantaged(spark, d), G, K))
    return rounded(mix, "mean_abs_advantage", "kept_share")


# --- rounds -----------------------------------------------------------------------------

_QUESTIONS_SQL = """questions as (select o_orderkey as group_id, o_custkey % 5 as run_id from orders),
  numbered as (select *, row_number() over (partition by run_id order by md5('42:' || cast(group_id as varchar)),
      group_id) - 1 as "row", count(*) over (partition by run_id) as total from questions)"""


def _questions(spark, d):
    return v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("group_id"), (F.col("o_custkey") % 5).alias("run_id")
    )


@query("win_8_assign_rounds", f"""with {_QUESTIONS_SQL} select run_id, group_id, "row", "row" // 16 as round
    from numbered where "row" // 16 < total // 16""")
def win_8(spark, d):
    return assign_rounds(_questions(spark, d), 16)


@query("win_9_assign_microbatches", f"""{v.RANKED_SQL}, kept as (select run_id, step as round, group_id, sample_idx
    from ranked where rnk <= {K}), sized as (select *, row_number() over (partition by run_id, round
    order by group_id, sample_idx) - 1 as rn, count(*) over (partition by run_id, round) // 8 as size from kept)
    select run_id, round, group_id, sample_idx, cast(rn // size as int) as microbatch from sized
    where rn < size * 8""")
def win_9(spark, d):
    kept = pr.select_topk(v.advantaged(spark, d), K, G).select(
        "run_id", F.col("step").alias("round"), "group_id", "sample_idx"
    )
    return assign_microbatches(kept, 8)


@query("win_9_chained_rounds", f"""{v.RANKED_SQL}, questions as (select distinct run_id, group_id from ranked),
    shuffled as (select *, row_number() over (partition by run_id order by md5('42:' || group_id), group_id) - 1 as rn,
    count(*) over (partition by run_id) as n from questions), rounds as (select run_id, group_id, rn // 16 as round
    from shuffled where rn // 16 < n // 16), kept as (select r.run_id, r.round, k.group_id, k.sample_idx from ranked k
    join rounds r using (run_id, group_id) where k.rnk <= {K}), sized as (select *, row_number() over (partition by
    run_id, round order by group_id, sample_idx) - 1 as rn, count(*) over (partition by run_id, round) // 8 as size
    from kept) select run_id, round, group_id, sample_idx, cast(rn // size as int) as microbatch from sized
    where rn < size * 8""")
def win_9_chained(spark, d):
    """Rounds of 16 questions, so a window holds at most 16 * k rows at any size."""
    kept = pr.select_topk(v.advantaged(spark, d), K, G).select("run_id", "group_id", "sample_idx")
    questions = v.rollouts(spark, d).select("run_id", "group_id").distinct()
    rounds = assign_rounds(questions, 16).select("run_id", "group_id", "round")
    return assign_microbatches(kept.join(rounds, ["run_id", "group_id"]), 8)


# --- objectives -------------------------------------------------------------------------

_SURROGATE_COLUMNS = ("surrogate", "plain_surrogate", "clipped_low", "clipped_high", "kl")


@query("obj_1_token_surrogate", f"""{v.LOGPROBS_SQL} select group_id, sample_idx,
    cast(loss_tokens as int) as loss_tokens, {q6('surrogate', 'surrogate')} from surrogates""")
def obj_1(spark, d):
    rows = ob.token_surrogate(v.logprobs(spark, d))
    rows = rows.select("group_id", "sample_idx", "loss_tokens", "surrogate")
    return rounded(rows, "surrogate")


@query("obj_2_group_objective", f"""{v.LOGPROBS_SQL} select run_id, group_id,
    {q6(f'sum(surrogate / loss_tokens) / {G}', 'objective')} from surrogates group by all""")
def obj_2(spark, d):
    rows = ob.token_surrogate(v.logprobs(spark, d))
    return rounded(ob.group_objective(rows, G), "objective")


@query("obj_2_pruned_objective", f"""{v.LOGPROBS_SQL} select run_id, group_id,
    {q6(f'sum(surrogate / loss_tokens) / {K}', 'objective')} from surrogates where rnk <= {K} group by all""")
def obj_2_pruned(spark, d):
    kept = pr.select_topk(v.logprobs(spark, d), K, G).withColumn("kept", F.lit(True))
    return rounded(ob.group_objective(ob.token_surrogate(kept), G, K), "objective")


@query("obj_3_dapo_loss", f"""{v.LOGPROBS_SQL} select run_id, cast(sum(loss_tokens) as bigint) as num_items,
    {q6('-sum(surrogate) / sum(loss_tokens)', 'loss')} from surrogates where rnk <= {K} group by all""")
def obj_3(spark, d):
    kept = pr.select_topk(v.logprobs(spark, d), K, G)
    return rounded(ob.dapo_loss(ob.token_surrogate(kept)), "loss")


@query("obj_4_kl_penalty", f"""{v.LOGPROBS_SQL} select group_id, sample_idx, {q6('0.04::double * kl', 'kl')}
    from surrogates""")
def obj_4(spark, d):
    rows = ob.kl_penalty(v.logprobs(spark, d), 0.04)
    return rounded(rows.select("group_id", "sample_idx", "kl"), "kl")


@query("obj_5_clip_metrics", f"""{v.LOGPROBS_SQL}, parts as (select run_id, step, group_id, sum(clipped_low) as lo,
    sum(clipped_high) as hi, sum(loss_tokens) as n from surrogates group by all) select run_id, step,
    {q6('sum(lo) / sum(n)', 'clip_ratio/low_mean')}, {q6('min(lo / n)', 'clip_ratio/low_min')},
    {q6('sum(hi) / sum(n)', 'clip_ratio/high_mean')}, {q6('max(hi / n)', 'clip_ratio/high_max')},
    {q6('(sum(lo) + sum(hi)) / sum(n)', 'clip_ratio/region_mean')} from parts group by run_id, step""")
def obj_5(spark, d):
    metrics = ob.clip_metrics(ob.token_surrogate(v.logprobs(spark, d)))
    return rounded(metrics, *[c for c in metrics.columns if c not in ("run_id", "step")])


@query("obj_6_mean_surrogate", f"""{v.LOGPROBS_SQL} select run_id, {q6('-sum(plain) / sum(tokens)', 'loss')}
    from surrogates group by run_id""")
def obj_6(spark, d):
    return rounded(ob.mean_surrogate(v.logprobs(spark, d)), "loss")


_GRID = (0.0, 0.5, 0.75, 0.875)


@query("obj_7_objective_grid", f"""{v.LOGPROBS_SQL}, grid as (select unnest([0.0, 0.5, 0.75, 0.875]::double[]) as p),
    ks as (select p, cast(floor({G} * (1 - p)) as int) as k from grid), per_group as (select run_id, group_id, p, k,
    sum(surrogate / loss_tokens) as o from surrogates join ks on rnk <= k group by all)
    select run_id, p as pruning_rate, k, {q6('avg(o / k)', 'objective')} from per_group group by run_id, p, k""")
def obj_7(spark, d):
    order = [F.abs("advantage").cast("float").desc(), F.col("sample_idx")]
    rank = F.row_number().over(group_window(["run_id", "group_id"]).orderBy(*order))
    ranked = v.logprobs(spark, d).withColumn("rank", rank)
    return rounded(ob.objective_grid(ob.token_surrogate(ranked), G, _GRID), "objective")
