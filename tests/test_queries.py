"""Every registered query against its SQL over the same tables."""

import pytest
from pyspark.sql import functions as F

import oracle
from winnow.plans.catalog import ORACLES, QUERIES


# There, no user has exactly eight events in a block, and rounds hold fewer rows than steps.
EMPTY_AT_THE_SMALLEST_SCALE = {"win_5_ragged_drop", "win_9_assign_microbatches"}


@pytest.fixture(scope="module")
def tables(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    frame = QUERIES[name](spark, sf_dir)
    rows, problems = oracle.compare(frame, tables, ORACLES[name])
    assert rows > 0 or name in EMPTY_AT_THE_SMALLEST_SCALE
    assert not problems
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_entry(spark):
    from __spark_entry__ import entry

    frame = entry(spark)
    assert frame.count() == 5
    assert "retained_signal_fraction" in frame.columns


ROLLOUTS = """
with e as (
  select event_id, user_id,
         row_number() over (partition by user_id order by event_id) - 1 as rn,
         cast(event_id % 5 as varchar(10)) as c
  from fixture_events),
g as (
  select user_id * 1000 + cast(floor(rn / 8) as bigint) as group_id,
         cast(rn % 8 as int) as sample_idx,
         cast(user_id % 5 as varchar(10)) as solution, user_id % 5 as run_id,
         case cast(event_id % 8 as int)
           when 0 then 'so ' || chr(92) || 'boxed{' || c || '}'
           when 1 then chr(92) || 'boxed{' || chr(92) || 'frac{' || c || '}{1}}'
           when 2 then chr(92) || 'boxed{9} then ' || chr(92) || 'boxed{' || c || '}'
           when 3 then 'step 1, so the total is ' || c
           when 4 then chr(92) || 'boxed{' || c
           when 5 then '<think>' || chr(10) || 'r</think>' || chr(10) || '<answer> ' || c || ' </answer>'
           when 6 then chr(92) || 'boxed{ ' || c || '.0 }'
           else 'no digits here' end as completion
  from e)
select * from (select g.*, count(*) over (partition by group_id) as gsz from g) t where gsz = 8
"""


@pytest.mark.parametrize("scale, share", [("sf0.001", 0.4480), ("sf0.01", 0.4389)])
def test_signal_share_of_the_fixture_rollouts(spark, scale, share):
    """Shares that a plain loop over the same view gave."""
    from winnow.operators import diagnostics as dg
    from winnow.operators import pruning as pr
    from winnow.operators.scoring import group_advantage, score

    spark.read.parquet(f"/root/testdata/{scale}/events.parquet").createOrReplaceTempView("fixture_events")
    marked = pr.mark_kept(group_advantage(score(spark.sql(ROLLOUTS))), 8, 2)
    if scale == "sf0.01":
        mix = marked.groupBy("`rewards/format_reward_boxed`", "`rewards/accuracy_reward`").count()
        assert {tuple(r) for r in mix.collect()} == {
            (0.0, 0.0, 4951), (1.0, 0.0, 2854), (0.0, 2.0, 969), (1.0, 2.0, 690)}
    summary = dg.summarize_pruning(marked.withColumn("all", F.lit(1)), by=["all"]).first()
    assert summary.retained_signal_fraction == pytest.approx(share, abs=5e-5)
    assert summary.num_retained_per_group == 2
    assert summary.num_degenerate_groups == (9 if scale == "sf0.01" else 0)
