"""Registered streaming queries. Each drains the given events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pruning as pr
from ..operators.scoring import group_advantage
from ..sources.writers import scratch_dir
from ..streaming import streams as st
from . import views as v
from .registry import q6, query, rounded

G, K = v.GROUP_SIZE, 2
DELAY = "1 hour"


def _event_stream(spark, d) -> DataFrame:
    """The events as a stream."""
    schema = v.table(spark, d, "events").schema
    return _zoned(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


def _events(spark, d) -> DataFrame:
    """The same events as a batch."""
    return _zoned(v.table(spark, d, "events"))


def _zoned(events: DataFrame) -> DataFrame:
    """``ts`` has no zone in the files and is taken as UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz"))
    return events.withColumn("ts", local.cast("timestamp"))


def _without_zone(df: DataFrame, *names: str) -> DataFrame:
    """Instants as UTC times without a zone, the type the files have."""
    return df.withColumns(
        {
            name: F.convert_timezone(
                F.current_timezone(), F.lit("UTC"), F.col(name).cast("timestamp_ntz")
            )
            for name in names
        }
    )


def _drain(spark, stream: DataFrame, name: str) -> st.Drained:
    return st.drain(stream, scratch_dir(spark, name), scratch_dir(spark, name + "-state"))


@query("stm_1_score_stream", f"""{v.SCORED_SQL} select group_id, sample_idx, acc as accuracy, fmt as format,
    reward from scored""")
def stm_1(spark, d):
    scored = st.score_stream(v.rollouts_of(_event_stream(spark, d))).select(
        "group_id", "sample_idx",
        F.col("`rewards/accuracy_reward`").alias("accuracy"),
        F.col("`rewards/format_reward_boxed`").alias("format"),
        "reward",
    )
    return _drain(spark, scored, "scored").rows


_KEYS = ("run_id", "group_id", "sample_idx")


#: Event ids follow time, so a group is complete long before a day has passed.
_WAIT = "1 day"


def _marked(spark, d, make, emit: str = "complete") -> DataFrame:
    """All rows of all groups, marked by the stream; ragged ones that were open at the end of the data, too."""
    scored = lambda events: st.score_stream(make(events))
    marked = st.mark_stream(scored(_event_stream(spark, d)), G, K, delay=_WAIT, emit=emit)
    return st.with_open_groups(_drain(spark, marked, "marked"), scored(_events(spark, d)), G, K, delay=_WAIT, emit=emit)


_KEPT = ("run_id", "group_id", "sample_idx", "reward", "advantage", "whole")


@query("stm_2_prune_stream", f"""{v.RANKED_SQL} select run_id, group_id, sample_idx, reward,
    {q6('advantage', 'advantage')}, true as whole from ranked where rnk <= {K}""")
def stm_2(spark, d):
    return rounded(_marked(spark, d, v.rollouts_of).where("kept").select(*_KEPT), "advantage")


def _window_sql(slide_hours: int) -> str:
    count = 24 // slide_hours
    return f"""{v.RANKED_SQL}, spans as (select *,
    time_bucket(interval '{slide_hours} hours', ts) - to_hours({slide_hours} * unnest(range(0, {count}))) as window_start
    from ranked)
    select window_start, window_start + interval '24 hours' as window_end, run_id, count(*) as completions,
    {q6('avg(reward)', 'reward')}, {q6(f'avg(case when rnk <= {K} then 1 else 0 end)', 'retention')},
    {q6('avg(case when n_tokens >= 1024 then 1 else 0 end)', 'clipped_ratio')} from spans group by window_start, run_id"""


def _metrics(spark, d, slide: str | None) -> DataFrame:
    """Windows over what pruning kept, streamed from where the marked rows landed."""
    path = scratch_dir(spark, "landed")
    _marked(spark, d, v.rollouts_of).write.parquet(path)
    landed = spark.read.parquet(path)
    of = lambda rows: st.metrics_stream(rows, "1 day", slide, DELAY, v.CAP)
    drained = _drain(spark, of(spark.readStream.schema(landed.schema).parquet(path)), "metrics")
    metrics = st.closed(drained, of(landed), "window_end")
    return rounded(_without_zone(metrics, "window_start", "window_end"), "reward", "retention", "clipped_ratio")


query("stm_3_tumbling_metrics", _window_sql(24))(lambda s, d: _metrics(s, d, None))
query("stm_3_sliding_metrics", _window_sql(6))(lambda s, d: _metrics(s, d, "6 hours"))


@query("stm_4_session_timings", f"""with {v.TIMINGS_SQL}, gaps as (select *, case when ts >= lag(ts) over
    (partition by run_id order by ts) + interval '20 minutes' then 1 else 0 end as opens from timing),
    numbered as (select *, sum(opens) over (partition by run_id order by ts) as session from gaps),
    sessions as (select run_id, session, min(ts) as session_start, max(ts) + interval '20 minutes' as session_end,
    count(*) as events, sum(case when kind = 'train_step' then seconds else 0 end) as t,
    sum(case when kind = 'rollout' then seconds else 0 end) as r from numbered group by all)
    select session_start, session_end, run_id, events, {q6('t', 'train_step_seconds')}, {q6('r', 'rollout_seconds')},
    {q6('greatest(0, t - r)', 'update_seconds')} from sessions""")
def stm_4(spark, d):
    kind = F.when(F.col("event_type") == "view", "rollout").when(
        F.col("event_type") == "purchase", "train_step"
    )
    def of(events: DataFrame) -> DataFrame:
        timed = events.select((F.col("user_id") % 5).alias("run_id"), kind.alias("kind"),
                              F.col("value").alias("seconds"), "ts")
        return st.timings_stream(timed, "20 minutes", DELAY)

    drained = _drain(spark, of(_event_stream(spark, d)), "timings")
    timings = st.closed(drained, of(_events(spark, d)), "session_end")
    timings = _without_zone(timings, "session_start", "session_end")
    return rounded(timings, "train_step_seconds", "rollout_seconds", "update_seconds")


@query("stm_5_land_rounds", f"""{v.RANKED_SQL} select run_id, count(*) as kept, {q6('sum(reward)', 'reward')}
    from ranked where rnk <= {K} group by run_id""")
def stm_5(spark, d):
    stream = st.score_stream(v.rollouts_of(_event_stream(spark, d)))
    kept = st.prune_stream(stream, G, K, delay=_WAIT, emit="complete")
    landed = st.land_available(kept, scratch_dir(spark, "rounds"), scratch_dir(spark, "rounds-state"))
    rows = landed.rows.groupBy("run_id")
    return rounded(rows.agg(F.count(F.lit(1)).alias("kept"), F.sum("reward").alias("reward")), "reward")


def _uneven(events: DataFrame) -> DataFrame:
    """Rollouts with ragged groups, oversize ones, and positions that repeat."""
    rows = v.rollouts_of(events)
    number = F.col("event_id") % 8
    moved = F.when((F.col("group_id") % 7 == 3) & (number < 2), F.col("group_id") - 1).otherwise(F.col("group_id"))
    place = F.when(moved != F.col("group_id"), 8 + number).when(
        (F.col("group_id") % 7 == 5) & (number == 7), 0).otherwise(F.col("sample_idx"))
    return rows.withColumns({"group_id": moved, "sample_idx": place.cast("int")})


@query("stm_2_uneven_matches_batch", "select cast(0 as bigint) as differing")
def stm_2_uneven(spark, d):
    """Rows on whose fate streaming and batch pruning differ, over uneven groups: none."""
    streamed = _marked(spark, d, _uneven).select(*_KEYS, "whole", "kept")
    rows = st.score_stream(_uneven(_events(spark, d))).dropDuplicates(list(_KEYS))
    batch = pr.mark_kept(group_advantage(rows), G, K, on_ragged="keep")
    batch = batch.select(*_KEYS, (F.col("group_rows") == G).alias("whole"), "kept")
    return _differing(streamed, batch)


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    either = left.withColumn("n", F.lit(1)).unionByName(right.withColumn("n", F.lit(-1)))
    net = either.groupBy(*left.columns).agg(F.sum("n").alias("n"))
    return net.agg(F.count_if(F.col("n") != 0).alias("differing"))


@query("stm_2_matches_batch", "select cast(0 as bigint) as differing")
def stm_2_batch(spark, d):
    """Rows that streaming and batch pruning do not share: none."""
    streamed = _marked(spark, d, v.rollouts_of).where("kept").select(*_KEYS)
    batch = pr.select_topk(group_advantage(v.scored(spark, d)), K, G).select(*_KEYS)
    return _differing(streamed, batch)
