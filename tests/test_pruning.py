"""Advantages, selection and diagnostics on stated cases, properties and hot groups."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow.operators import diagnostics as dg
from winnow.operators import pruning as pr
from winnow.operators.rounds import assign_microbatches, assign_rounds
from winnow.operators.scoring import group_advantage
from winnow.operators.skew import lookup, with_group_stats

ROWS = "run_id long, group_id long, sample_idx int, advantage double, step long"


def frame(spark, values, size):
    rows = [(0, i // size, i % size, float(v), 0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, ROWS)


def kept(df):
    return sorted((r.group_id, r.sample_idx) for r in df.collect())


def flat(df, size):
    return sorted(g * size + i for g, i in kept(df))


def test_largest_magnitudes_win_and_ties_go_to_the_lower_index(spark):
    values = [.1, -2, .5, 1.5, -.2, .3, -3, .4]
    assert flat(pr.select_topk(frame(spark, values, 4), 2, 4), 4) == [1, 3, 6, 7]
    assert flat(pr.select_topk(frame(spark, [1, -1, 1, -1], 4), 2, 4), 4) == [0, 1]
    assert flat(pr.select_topk(frame(spark, [-5, 1, 2, 3], 4), 1, 4), 4) == [0]
    assert flat(pr.select_topk(frame(spark, values, 4), 4, 4), 4) == list(range(8))


def test_ties_are_decided_in_single_precision(spark):
    close = [1.0, 1.0 + 1e-12, 1.0, 0.0]
    assert flat(pr.select_topk(frame(spark, close, 4), 1, 4), 4) == [0]


def test_zero_advantages_can_be_dropped(spark):
    rows = frame(spark, [0, 0, 0, 0, 1, -1, .5, -.5], 4)
    assert flat(pr.prune(rows, 4, 2, drop_zero=True), 4) == [4, 5]
    zeros = frame(spark, [0] * 8, 4)
    assert pr.prune(zeros, 4, 2, drop_zero=True).count() == 0
    fallback = pr.prune(zeros, 4, 2, drop_zero=True, batch=["run_id", "step"])
    assert flat(fallback, 4) == [0, 1, 4, 5]
    mixed = pr.prune(rows, 4, 2, drop_zero=True, batch=["run_id", "step"])
    assert flat(mixed, 4) == [4, 5]


def test_group_size_and_k_may_be_columns(spark):
    rows = frame(spark, [3, 2, 1, 0, 3, 2, 1, 0], 4).withColumn("k", F.col("group_id") + 1)
    assert flat(pr.prune(rows.withColumn("g", F.lit(4)), "g", "k"), 4) == [0, 4, 5]


def test_ragged_groups(spark):
    rows = frame(spark, [3, 2, 1, 0, 3, 2], 4)
    with pytest.raises(Exception, match="has 2 completions, expected 4"):
        pr.select_topk(rows, 2, 4).collect()
    with pytest.raises(Exception, match="has 2 completions, expected 4"):
        pr.mark_kept(rows, 4, 2).collect()
    assert flat(pr.prune(rows, 4, 2, on_ragged="keep"), 4) == [0, 1, 4, 5]
    assert flat(pr.prune(rows, 4, 2, on_ragged="drop"), 4) == [0, 1]
    with pytest.raises(ValueError):
        pr.select_topk(rows, 5, 4)
    with pytest.raises(ValueError):
        pr.select_topk(rows, 0, 4)
    with pytest.raises(ValueError):
        pr.select_topk(rows, 2, 4, on_ragged="other")


def test_evaluation_rows_are_not_pruned(spark):
    rows = frame(spark, [3, 2, 1, 0, 3, 2, 1, 0], 4)
    assert flat(pr.prune(rows, 4, 1, training=F.col("group_id") == 0), 4) == [0, 4, 5, 6, 7]


def test_summary_cases(spark):
    rows = pr.mark_kept(frame(spark, [3, -2, .05, -.05], 4), 4, 2)
    stats = dg.summarize_pruning(rows).first()
    assert (stats.num_total, stats.num_kept, stats.num_degenerate_groups) == (4, 2, 0)
    assert stats.retained_signal_fraction == pytest.approx(5.0 / 5.1, rel=1e-6)
    assert stats.mean_abs_advantage_kept == pytest.approx(2.5)
    assert stats.mean_abs_advantage_dropped == pytest.approx(0.05)
    zeros = dg.summarize_pruning(pr.mark_kept(frame(spark, [0] * 8, 4), 4, 2)).first()
    assert (zeros.num_degenerate_groups, zeros.retained_signal_fraction) == (2, 1.0)


rewards_lists = st.lists(st.lists(st.sampled_from([0.0, 1.0, 2.0, 3.0]), min_size=8, max_size=8),
                         min_size=3, max_size=12)


def rewarded(spark, groups, shift=0.0, sign=1.0):
    rows = [(0, g, i, sign * r + shift) for g, group in enumerate(groups) for i, r in enumerate(group)]
    return spark.createDataFrame(rows, "run_id long, group_id long, sample_idx int, reward double")


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rewards_lists)
def test_selection_properties(spark, groups):
    base = kept(pr.select_topk(group_advantage(rewarded(spark, groups)), 2, 8))
    assert len(base) == 2 * len(groups)
    shuffled = rewarded(spark, groups).repartition(5, "sample_idx")
    assert kept(pr.select_topk(group_advantage(shuffled), 2, 8)) == base
    assert kept(pr.select_topk(group_advantage(rewarded(spark, groups, 4.0)), 2, 8)) == base
    assert kept(pr.select_topk(group_advantage(rewarded(spark, groups, 0.0, -1.0)), 2, 8)) == base
    marked = pr.mark_kept(group_advantage(rewarded(spark, groups)), 8, 2)
    share = dg.summarize_pruning(marked).first().retained_signal_fraction
    assert 2 / 8 - 1e-9 <= share <= 1.0


def hot_rows_frame(spark):
    """A third of all rows in one group; the rest in whole groups of 4; one NULL group."""
    hot = spark.range(400).select(F.lit(0).cast("long").alias("run_id"), F.lit(-1).cast("long").alias("group_id"),
                                  F.col("id").cast("int").alias("sample_idx"))
    rest = spark.range(800).select(F.lit(0).cast("long"), F.expr("id div 4"), F.expr("cast(id % 4 as int)"))
    null = spark.range(60).select(F.lit(0).cast("long"), F.lit(None).cast("long"), F.col("id").cast("int"))
    return hot.union(rest).union(null).withColumn("reward", (F.xxhash64("group_id", "sample_idx") % 4).cast("double"))


@pytest.mark.parametrize("scale", ["group", "batch", "none"])
def test_hot_groups_give_the_same_rows(spark, scale):
    rows = hot_rows_frame(spark)
    batch = ["run_id"]

    def run(hot_rows):
        got = group_advantage(rows, scale=scale, batch=batch, hot_rows=hot_rows)
        marked = pr.mark_kept(got, 4, 2, on_ragged="keep", hot_rows=hot_rows, drop_zero=True, batch=batch)
        return {(r.group_id, r.sample_idx): (r.group_rows, round(r.advantage, 9), r.kept)
                for r in marked.collect()}

    plain, split = run(10**6), run(50)
    assert len(plain) == 1260
    assert plain == split
    assert plain[(-1, 0)][0] == 400 and plain[(None, 0)][0] == 60


def test_hot_groups_are_divided(spark):
    divided = with_group_stats(hot_rows_frame(spark), ["run_id", "group_id"], {"n": F.count(F.lit(1))}, 50)
    pieces = divided.groupBy("group_id", "_spread").count().collect()
    hot = [r["count"] for r in pieces if r.group_id == -1]
    assert len(hot) == 8 and max(hot) < 100
    assert all(r._spread == 0 for r in pieces if r.group_id not in (-1, None))


def test_lookup_equals_a_left_join(spark):
    rows = hot_rows_frame(spark)
    table = spark.createDataFrame([(-1, "hot", 1), (3, "cold", 2), (5, None, None)],
                                  "group_id long, name string, value int")
    want = {(r.group_id, r.sample_idx): (r.name, r.value)
            for r in rows.where("group_id is not null").join(table, "group_id", "left").collect()}
    for hot_rows in (50, 10**6):
        got = {(r.group_id, r.sample_idx): (r.name, r.value)
               for r in lookup(rows, table, ["group_id"], hot_rows).where("group_id is not null").collect()}
        assert got == want


def test_lookup_spreads_hot_keys_without_a_table_row(spark):
    rows = hot_rows_frame(spark)
    table = spark.createDataFrame([(3, "cold")], "group_id long, name string")
    got = lookup(rows, table, ["group_id"], 50)
    assert got.count() == 1260
    assert got.where("group_id = -1 and name is not null").count() == 0
    assert got.where("name = 'cold'").count() == 4


def test_rounds_cover_whole_rounds_in_a_seeded_order(spark):
    questions = spark.range(1000).select((F.col("id") % 3).alias("run_id"), F.col("id").alias("group_id"))
    rounds = assign_rounds(questions, 16, bucket_digits=1)
    per_round = rounds.groupBy("run_id", "round").count().collect()
    assert {r["count"] for r in per_round} == {16}
    assert len(per_round) == sum(n // 16 for n in (334, 333, 333))
    again = assign_rounds(questions.repartition(7), 16, bucket_digits=3)
    assert rounds.exceptAll(again.select(*rounds.columns)).count() == 0


def test_microbatches_are_equal_and_drop_the_remainder(spark):
    rows = spark.range(103).select(F.lit(0).alias("run_id"), F.lit(0).alias("round"),
                                   F.col("id").alias("group_id"), F.lit(0).alias("sample_idx"))
    sizes = assign_microbatches(rows, 8).groupBy("microbatch").count().collect()
    assert sorted((r.microbatch, r["count"]) for r in sizes) == [(i, 12) for i in range(8)]


@pytest.mark.parametrize("hot_rows", [1, 7, 10, 99, 100, 101, 10**6])
@pytest.mark.parametrize("size", [100, "column"])
def test_topk_does_not_depend_on_hot_rows(spark, hot_rows, size):
    rows = spark.range(250).select(
        F.lit(0).cast("long").alias("run_id"), F.expr("id div 100").alias("group_id"), F.expr("cast(id % 100 as int)").alias("sample_idx"),
        (F.xxhash64("id") % 50).cast("double").alias("reward"), F.lit(True).alias("flag"), F.lit(100).alias("g"))
    got = group_advantage(rows, hot_rows=hot_rows)
    plain = group_advantage(rows)
    options = {"on_ragged": "keep", "hot_rows": hot_rows}
    marked = pr.mark_kept(got, "g" if size == "column" else size, 2, **options)
    want = kept(pr.mark_kept(plain, 100, 2, on_ragged="keep").where("kept"))
    assert kept(marked.where("kept")) == want and len(want) == 2 + 2 + 50
    whole = pr.select_topk(got.where("group_id < 2"), 2, 100, hot_rows=hot_rows)
    assert kept(whole) == want[:4]


@pytest.mark.parametrize("order", ["abs", "signed", "smallest", "random"])
def test_every_selector_falls_back(spark, order):
    values = [0, 0, 0, 5, 0, 0, 0, 0]
    marked = pr.mark_kept(frame(spark, values, 4), 4, 2, order=order, drop_zero=True, batch=["run_id", "step"])
    rows = {(r.group_id, r.sample_idx) for r in marked.where("kept").collect()}
    plain = {(r.group_id, r.sample_idx) for r in pr.mark_kept(frame(spark, values, 4), 4, 2, order=order).where("kept").collect()}
    assert rows == ({(0, 3)} if (0, 3) in plain else plain) and rows


def test_a_ragged_group_keeps_its_batch(spark):
    rows = frame(spark, [3, 2, 1, 0, 3, 2], 4).unionByName(frame(spark, [3, 2, 1, 0], 4).withColumn("step", F.lit(1).cast("long")).withColumn(
        "group_id", F.lit(9).cast("long")))
    marked = pr.mark_kept(rows, 4, 2, on_ragged="keep_batch", batch=["run_id", "step"])
    assert kept(marked.where("kept")) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (9, 0), (9, 1)]
    with pytest.raises(ValueError):
        pr.mark_kept(rows, 4, 2, on_ragged="keep_batch")


def test_texts_alone_divide_a_hot_key(spark):
    rows = spark.range(1000).select(F.lit(1).alias("key"), F.lit(True).alias("flag"), F.concat(F.lit("text "), "id").alias("text"))
    divided = with_group_stats(rows, ["key"], {"n": F.count(F.lit(1))}, 10)
    assert divided.groupBy("_spread").count().agg(F.max("count")).first()[0] < 40


def test_scores_follow_the_verifier_and_the_registry(spark):
    from winnow.functions import rewards
    from winnow.operators.scoring import score

    rows = spark.createDataFrame([("\\\\boxed{two}".replace("\\\\", "\\"), "2"), ("\\boxed{3}", "2")], "completion string, solution string")
    check = rewards.python_verifier(lambda left, right: (left, right) == ("two", "2"))
    assert [r["rewards/accuracy_reward"] for r in score(rows, verifier=check).collect()] == [2.0, 0.0]
    built_in = rewards.reward_builder("accuracy_reward")
    rewards.register_reward("accuracy_reward", lambda completion, solution: F.lit(7.0))
    try:
        assert [r["rewards/accuracy_reward"] for r in score(rows).collect()] == [7.0, 7.0]
    finally:
        rewards.register_reward("accuracy_reward", built_in)


def test_a_run_without_an_id_is_told_from_all_runs(spark):
    from winnow.operators.diagnostics import outcome_mix

    rows = spark.createDataFrame(
        [(None, 1.0, 2.0, 0.5, True), (None, 0.0, 0.0, -0.5, False), (7, 1.0, 0.0, 0.1, True)],
        "run_id long, `rewards/format_reward_boxed` double, `rewards/accuracy_reward` double, advantage double, kept boolean")
    mix = {(r.run_id, r.outcome, r.level): r.completions for r in outcome_mix(rows).collect()}
    assert (mix[None, None, 1], mix[None, None, 3], mix[7, None, 1]) == (2, 3, 1) and len(mix) == 6
