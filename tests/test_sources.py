"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from winnow.operators import prompts as pm
from winnow.operators import runs as rn
from winnow.sources import readers as rd
from winnow.sources import writers as wr


def test_profiles_are_read_one_object_per_file(spark, tmp_path):
    profile = {
        "run_id": 7, "run_name": "a", "geometry": {"pruning_rate": 0.5, "num_generations": 4},
        "stages": {"rollout_seconds": 28.7, "completions_generated": 16, "unknown": 1},
        "log_history": [{"reward": 0.25, "completions/clipped_ratio": 1.0}, {"train_loss": 0.0}],
        "wall_clock_seconds": 550, "settings": {"seed": 42, "report_to": []},
    }
    (tmp_path / "a.json").write_text(json.dumps(profile, indent=2))
    rows = rd.read_profiles(spark, str(tmp_path / "*.json"))
    summary = rn.summarize_runs(rows).first()
    assert (summary.run_name, summary.pruning_rate, summary.questions_seen) == ("a", 0.5, 4)
    assert summary.final_reward == 0.25
    first = rows.first()
    assert first.log_history[0]["completions/clipped_ratio"] == 1.0
    assert first.settings["seed"] == "42" and first.source_file.endswith("a.json")


@pytest.mark.parametrize("content", ["[1, 2]", "3", '{"run_id": ', "[{}]", "plain"])
def test_anything_but_an_object_fails(spark, tmp_path, content):
    (tmp_path / "bad.json").write_text(content)
    with pytest.raises(Exception, match="does not contain a JSON object"):
        rd.read_profiles(spark, str(tmp_path)).collect()


def test_evals_keep_metric_text_and_summary(spark, tmp_path):
    payload = {"run_id": 1, "results": {"t": {"acc,none": 0.5, "alias": "t", "n": None}}, "scores": {"t": 50.0}}
    (tmp_path / "eval.json").write_text(json.dumps(payload))
    row = rd.read_evals(spark, str(tmp_path), summary_field="scores").first()
    assert row.results["t"]["acc,none"] == "0.5" and row.accuracies == {"t": 50.0}


def test_benchmark_points_keep_their_order(spark, tmp_path):
    payload = {"bench_id": 1, "num_generations": 8, "results": [{"num_retained": k} for k in (8, 4, 1)]}
    (tmp_path / "bench.json").write_text(json.dumps(payload))
    rows = rd.read_benchmarks(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.position, r.num_retained, r.num_generations) for r in rows] == [(0, 8, 8), (1, 4, 8), (2, 1, 8)]


def test_logs_are_whole_files(spark, tmp_path):
    (tmp_path / "train.log").write_text("first\nsecond\n")
    row = rd.read_logs(spark, str(tmp_path)).first()
    assert row.value == "first\nsecond\n" and row.source_file.endswith("train.log")


def test_a_log_in_many_splits_has_the_same_first_match(spark, tmp_path):
    from winnow.plans import report as rp

    line = "{'completions/clipped_ratio': '%s'}\n"
    noise = "step\n" * 700
    logs = {"a.log": noise + line % "0.25" + noise + line % "0.75", "b.log": line % "1e0" + noise + line % "0.1",
            "c.log": noise, "d.log": "", "e.log": noise * 2 + line % "1.2.3" + line % "0.1"}
    for name, value in logs.items():
        (tmp_path / name).write_text(value)
    whole = {r.source_file: (r.clipped_ratio, r.status) for r in rp.log_gate(rd.read_logs(spark, str(tmp_path))).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = rd.scan_logs(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > len(logs)
        gate = rp.scanned_log_gate(lines)
        got = {r.source_file: (r.clipped_ratio, r.status) for r in gate.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k.rsplit("/", 1)[1]: x for k, x in got.items()} == {
        "a.log": (0.25, "pass"), "b.log": (1.0, "fail"), "c.log": (None, "missing"), "e.log": (None, "missing")}
    assert got == whole
    plan = gate._jdf.queryExecution().sparkPlan().toString()
    assert "partial_min_by" in plan and "SortAggregate" not in plan


def test_text_keeps_reading_order(spark, tmp_path):
    path = str(tmp_path / "deep" / "report")
    lines = spark.range(1000).select(F.format_string("%04d", "id").alias("line")).orderBy("line")
    wr.write_text(lines, path)
    parts = sorted(p for p in (tmp_path / "deep" / "report").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts).split() == [f"{i:04d}" for i in range(1000)]


def test_write_once_skips_stored_runs(spark, tmp_path):
    path = str(tmp_path / "once")
    rows = spark.range(10).select((F.col("id") % 3).alias("run_id"), F.col("id").alias("v"))
    wr.write_once(rows.where("run_id < 2"), path)
    wr.write_once(rows.withColumn("v", F.col("v") + 100), path)
    stored = sorted((r.run_id, r.v) for r in spark.read.parquet(path).collect())
    assert stored == sorted([(i % 3, i) for i in range(10) if i % 3 < 2] + [(2, i + 100) for i in (2, 5, 8)])


def test_scratch_follows_the_shared_folder(spark):
    assert wr.scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_prompts_are_filtered_not_cut(spark):
    problems = spark.createDataFrame([(1, "short", "3"), (2, "word " * 50, "4")],
                                     "problem_id long, prompt string, solution string")
    lengths = pm.to_conversation(problems).select(
        "problem_id", pm.token_count(pm.render_chat("prompt")).alias("n")).collect()
    size = {r.problem_id: r.n for r in lengths}
    kept = lambda n: [r.problem_id for r in pm.filter_prompt_length(pm.to_conversation(problems), n).collect()]
    assert kept(size[1]) == [1] and kept(size[1] - 1) == []
    assert kept(size[2]) == [1, 2] and kept(0) == [1, 2]
    capped = pm.training_prompts(problems, max_samples=1, max_prompt_tokens=size[2])
    assert capped.count() == 1


def test_shuffle_depends_on_the_seed_only(spark):
    frame = spark.range(200).withColumnRenamed("id", "problem_id")
    order = lambda df, seed: [r[0] for r in pm.shuffle_rows(df, seed, "problem_id").collect()]
    assert order(frame, 42) == order(frame.repartition(7), 42) != order(frame, 43)
    assert order(frame, None) == list(range(200))


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_samples_of_any_size_hold_the_seeded_order(spark, digits):
    from winnow.operators import rounds

    frame = spark.range(500).withColumnRenamed("id", "problem_id")
    order = [r[0] for r in pm.shuffle_rows(frame, 42, "problem_id").collect()]
    for n in (0, 1, 123, 500, 900):
        rows = rounds.shuffled_sample(frame.repartition(3), n, 42, "problem_id", digits).orderBy("row").collect()
        assert [(r.problem_id, r.row) for r in rows] == [(k, i) for i, k in enumerate(order[:n])]


def test_a_sample_sorts_only_the_buckets_it_takes(spark):
    from winnow.operators import rounds

    frame = spark.range(5000).withColumnRenamed("id", "problem_id")
    sample = rounds.shuffled_sample(frame, 500, 42, "problem_id", 2)
    assert sample.count() == 500
    lines = sample._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("Filter" in line and "< 500)" in line for line in lines[joined:]), "\n".join(lines)


def test_a_cap_needs_a_seed(spark):
    problems = spark.createDataFrame([(1, "a", "3")], "problem_id long, prompt string, solution string")
    with pytest.raises(ValueError, match="seed"):
        pm.training_prompts(problems, max_samples=1, shuffle_seed=None)
    assert pm.training_prompts(problems, shuffle_seed=None).count() == 1
