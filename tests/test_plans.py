"""The physical plans that the operators rely on."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from winnow.operators import diagnostics as dg
from winnow.operators import objective as ob
from winnow.operators import pruning as pr
from winnow.operators.scoring import group_advantage
from winnow.plans import views as v
from winnow.plans.catalog import QUERIES
from winnow.sources.readers import read_clustered, write_clustered


def executed(df):
    """Final adaptive plan of a frame after running it."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_pruning_shuffles_rows_once_and_limits_groups(spark, sf_dir):
    plan = executed(pr.select_topk(v.advantaged(spark, sf_dir), 2, 8).select("group_id", "sample_idx"))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in plan
    assert "Join" not in plan  # no hot group: adaptive execution drops the hot branch


def test_marking_and_summing_need_no_further_row_shuffle(spark, sf_dir):
    marked = pr.mark_kept(v.advantaged(spark, sf_dir), 8, 2)
    plan = executed(dg.summarize_pruning(marked))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)
    # rows by group; then one row per group by group and by run
    assert len(exchanges) <= 3


def test_token_arrays_are_reduced_before_the_exchange(spark, sf_dir):
    rows = ob.token_surrogate(v.logprobs(spark, sf_dir))
    plan = executed(ob.dapo_loss(rows))
    last = plan[: plan.index("Exchange")]
    assert "logp_new" not in last


def test_only_needed_columns_are_read(spark, sf_dir):
    rows = v.rollouts(spark, sf_dir)
    plan = executed(dg.length_metrics(rows, 1024))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert schema == "event_id:bigint"


def test_hot_group_search_reads_keys_only(spark, sf_dir):
    from winnow.operators.skew import hot_keys

    plan = hot_keys(v.scored(spark, sf_dir), ["run_id", "group_id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint>" in plan


@pytest.mark.parametrize("name", [
    "win_1_batch_scale", "win_4_batch_fallback", "win_4_fallback_smallest", "win_6_degenerate", "jn_1_attach_solutions",
    "jn_4_with_run"])
def test_few_scans(spark, sf_dir, name):
    found = [q for q in QUERIES if q == name or q.startswith(name.rsplit("_", 1)[0])]
    for query in found or [name]:
        plan = QUERIES[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= 3, query
        assert plan.count("Exchange hashpartitioning") <= 5, query


def test_clustered_rollouts_need_no_shuffle_by_group(spark, sf_dir, tmp_path):
    path = str(tmp_path / "clustered")
    write_clustered(v.scored(spark, sf_dir), path, 4)
    rows = read_clustered(spark, path)
    assert rows.dtypes == v.scored(spark, sf_dir).dtypes and rows.count() == v.scored(spark, sf_dir).count()
    plan = executed(dg.summarize_pruning(pr.mark_kept(group_advantage(rows), 8, 2)))
    assert "Window" in plan and not re.search(r"Exchange hashpartitioning\([^)]*group_id", plan)
    plan = executed(pr.select_topk(group_advantage(read_clustered(spark, path)), 2, 8))
    assert "Exchange" not in plan


@pytest.mark.parametrize("most", [4, None])
def test_topk_by_a_column_is_limited_before_the_exchange(spark, sf_dir, tmp_path, most):
    path = str(tmp_path / "advantages")
    v.advantaged(spark, sf_dir).write.parquet(path)
    rows = spark.read.parquet(path)
    best = pr.group_topk(rows, 1 + F.col("run_id") % 4, most=most)
    plan = executed(best)
    limits = [m.start() for m in re.finditer("WindowGroupLimit", plan)]
    assert len(limits) == 2 and limits[0] < plan.index("Exchange hashpartitioning") < limits[1]
    window = Window.partitionBy("run_id", "group_id").orderBy(F.abs("advantage").cast("float").desc(), "sample_idx")
    want = rows.withColumn("n", F.row_number().over(window)).where("n <= 1 + run_id % 4")
    assert sorted(map(str, best.select("event_id").collect())) == sorted(map(str, want.select("event_id").collect()))
    assert pr.group_topk(rows.limit(0), "run_id").count() == 0
