"""Run tables and reports on published numbers and stated cases."""

import pytest
from pyspark.sql import functions as F

from winnow import schemas
from winnow.operators import diagnostics as dg
from winnow.operators import evals as ev
from winnow.operators import runs as rn
from winnow.plans import report as rp

# name, P, k, m, steps, questions, wall, rollout, update, memory, reward
# Results that were published or must come out so.
PUBLISHED = [
    ("baseline", 0.0, 8, 1, 510, 8160, 11401.0, 5331.3, 5260.3, 48.05, 0.859),
    ("p50", 0.5, 4, 2, 255, 8160, 7559.4, 4372.5, 2751.9, 47.78, 0.750),
    ("p75", 0.75, 2, 4, 127, 8128, 5916.9, 4252.5, 1428.0, 47.90, 0.758),
    ("p875", 0.875, 1, 8, 63, 8064, 5544.7, 4672.0, 739.6, 47.76, 0.654),
    ("p75-no-allocation", 0.75, 2, 1, 510, 8160, 6465.0, 4787.2, 1439.2, 32.96, 0.836),
]
# Results that were published or must come out so.
PERFORMANCE = """\
| Method | P | k | m | Steps | Questions | Wall clock (s) | Rollout (s) | Update (s) | Peak mem (GiB) | Questions/s | Throughput gain |
|---|---|---|---|---|---|---|---|---|---|---|---|
| baseline | 0.00% | 8 | 1x | 510 | 8160 | 11401.0 | 5331.3 | 5260.3 | 48.05 | 0.7157 | 1.00x |
| p50 | 50.00% | 4 | 2x | 255 | 8160 | 7559.4 | 4372.5 | 2751.9 | 47.78 | 1.0795 | 1.51x |
| p75 | 75.00% | 2 | 4x | 127 | 8128 | 5916.9 | 4252.5 | 1428.0 | 47.90 | 1.3737 | 1.92x |
| p875 | 87.50% | 1 | 8x | 63 | 8064 | 5544.7 | 4672.0 | 739.6 | 47.76 | 1.4544 | 2.03x |
| p75-no-allocation | 75.00% | 2 | 1x | 510 | 8160 | 6465.0 | 4787.2 | 1439.2 | 32.96 | 1.2622 | 1.76x |""".split("\n")
# Results that were published or must come out so.
ACCURACIES = [(3.33, 36.85, 46.58), (0.0, 39.12, 44.56), (3.33, 38.51, 45.48), (0.0, 38.13, 45.80),
              (3.33, 38.13, 46.12), (0.0, 39.35, 45.12)]
TASKS = ("aime24", "gsm8k", "minerva_math")
ACCURACY = """\
| Method | P | aime24 | gsm8k | minerva_math | Final reward |
|---|---|---|---|---|---|
| untrained model | -- | 3.33 | 36.85 | 46.58 | -- |
| baseline | 0.00% | 0.00 | 39.12 | 44.56 | 0.859 |
| p50 | 50.00% | 3.33 | 38.51 | 45.48 | 0.750 |
| p75 | 75.00% | 0.00 | 38.13 | 45.80 | 0.758 |
| p875 | 87.50% | 3.33 | 38.13 | 46.12 | 0.654 |
| p75-no-allocation | 75.00% | 0.00 | 39.35 | 45.12 | 0.836 |""".split("\n")
# Results that were published or must come out so.
STEPS = [(8, .7083, .0006), (7, .6326, .0005), (6, .5467, .0011), (5, .4602, .0011), (4, .3816, .0006),
         (3, .2907, .0010), (2, .2120, .0010), (1, .1287, .0003)]
ALLOCATED = ["0.99x", "1.13x", "1.30x", "1.53x", "1.99x", "2.60x", "3.98x", "7.96x"]


def profiles(spark):
    rows = [
        (i, 1, name, "GRPO" if p == 0 else "pruned", steps, wall, mem,
         {"rollout_seconds": ro, "update_seconds": up, "completions_generated": q * 8,
          "completions_updated": q * k},
         {"num_generations": 8, "num_retained": k, "pruning_rate": p, "allocation_multiplier": m},
         [{"reward": 0.1}, {"reward": reward, "loss": 0.0}, {"train_loss": 0.0}])
        for i, (name, p, k, m, steps, q, wall, ro, up, mem, reward) in enumerate(PUBLISHED)
    ]
    fields = ("run_id", "experiment_id", "run_name", "algorithm", "global_step", "wall_clock_seconds",
              "peak_memory_allocated_gib", "stages", "geometry", "log_history")
    kind = type(schemas.PROFILE)([schemas.PROFILE[f] for f in fields])
    dicts = [dict(zip(fields, row)) for row in rows]
    return spark.createDataFrame(dicts, kind)


def lines(df):
    return [r.line for r in rp.in_order(df).collect()]


def points(spark):
    rows = [(1, i, 8, 1 - k / 8, k, 4 * k, 2048 * k, mean, dev, STEPS[0][1] / mean)
            for i, (k, mean, dev) in enumerate(STEPS)]
    return spark.createDataFrame(rows, "bench_id long, position int, num_generations int, pruning_rate double, "
                                 "num_retained int, completions_per_step long, tokens_per_step long, "
                                 "mean_step_seconds double, stdev_step_seconds double, speedup double")


def test_performance_table(spark):
    table = rp.performance_table(rn.summarize_runs(profiles(spark)))
    assert lines(rp.render(table, rp.PERFORMANCE_HEADERS, ["run_id"])) == PERFORMANCE


def test_accuracy_table(spark):
    runs = rn.summarize_runs(profiles(spark))
    scores = [(i - 1, t, a) for i, row in enumerate(ACCURACIES) for t, a in zip(TASKS, row)]
    frame = spark.createDataFrame(scores, "run_id long, task string, accuracy double")
    untrained, trained = frame.where("run_id < 0"), frame.where("run_id >= 0")
    table = rp.accuracy_table(runs, trained, TASKS, untrained)
    order = [F.col("is_baseline").cast("int") * -1, "run_id"]
    headers = ["Method", "P", *TASKS, "Final reward"]
    assert lines(rp.render(table, headers, order, placeholder=rp.NO_EVALS)) == ACCURACY
    missing = rp.accuracy_table(runs, trained.where("task <> 'gsm8k' or run_id <> 0"), TASKS)
    assert missing.where("run_id = 0").first()["gsm8k"] == "--"


def test_benchmark_table_and_fit(spark):
    cells = rp.benchmark_table(points(spark)).orderBy("position").collect()
    assert [r["Speedup (with allocation)"] for r in cells] == ALLOCATED
    assert cells[0]["Step time (s)"] == "0.7083 +/- 0.0006"
    fit = rn.linear_fit(points(spark), ["bench_id"], "completions_per_step", "mean_step_seconds").first()
    assert fit.intercept == pytest.approx(0.0447, abs=1e-4)
    assert fit.slope == pytest.approx(0.0209, abs=1e-4)
    assert fit.r2 == pytest.approx(0.99978, abs=1e-5)


def test_predicted_and_measured_speedups(spark):
    rows = rp.predicted_vs_measured(rn.summarize_runs(profiles(spark))).orderBy("run_id").collect()
    assert [round(r.predicted_speedup, 2) for r in rows[1:4]] == [1.3, 1.53, 1.68]
    assert [round(r.wall_clock_speedup, 2) for r in rows[1:4]] == [1.51, 1.93, 2.06]
    assert round(rows[0].ceiling, 2) == 1.86


def test_fit_edge_cases(spark):
    rows = [(1, 4.0, 2.0), (2, 4.0, 2.0), (2, 4.0, 6.0), (3, 1.0, 5.0), (3, 2.0, 5.0)]
    frame = spark.createDataFrame(rows, "b long, x double, y double")
    fits = {r.b: (r.intercept, r.slope, r.r2) for r in rn.linear_fit(frame, ["b"], "x", "y").collect()}
    assert fits == {1: (2.0, 0.0, 1.0), 2: (4.0, 0.0, 0.0), 3: (5.0, 0.0, 1.0)}


def test_unmeasured_run(spark):
    empty = spark.createDataFrame([{"run_id": 1, "experiment_id": 1}], schemas.PROFILE)
    row = rn.summarize_runs(empty).first()
    assert (row.run_name, row.algorithm, row.retention, row.final_reward) == ("unknown", "GRPO", 1.0, None)
    assert (row.update_share, row.questions_seen, row.questions_per_second) == (0.0, 0, 0.0)
    gain = rp.performance_table(rn.summarize_runs(empty)).first()["Throughput gain"]
    assert gain == "--x"


def test_placeholders_and_latex(spark):
    table = rp.performance_table(rn.summarize_runs(profiles(spark)))
    none = table.where("false")
    assert lines(rp.render(none, rp.PERFORMANCE_HEADERS, ["run_id"])) == [rp.NO_RUNS[0]]
    assert lines(rp.render(none, rp.PERFORMANCE_HEADERS, ["run_id"], latex=True)) == [rp.NO_RUNS[1]]
    latex = lines(rp.render(table, rp.PERFORMANCE_HEADERS, ["run_id"], latex=True))
    assert latex[1] == r"\begin{tabular}{lrrrrrrrrrrr}"
    assert latex[5].startswith(r"baseline & 0.00\% & 8 & 1x") and latex[5].endswith(r"1.00x \\")
    assert latex[-3:] == [r"\bottomrule", r"\end{tabular}", "}"]


def test_document(spark):
    table = rp.performance_table(rn.summarize_runs(profiles(spark)))
    bench = rp.benchmark_table(points(spark))
    for latex in (False, True):
        pages = rp.render_document([
            ("Training performance", rp.render(table, rp.PERFORMANCE_HEADERS, ["run_id"], latex)),
            ("Update stage, 50%", rp.render(bench, rp.BENCHMARK_HEADERS, ["position"], latex)),
        ], latex)
        text = [r.line for r in pages.collect()]
        assert text[0] == (r"\subsection*{Training performance}" if latex else "### Training performance")
        assert (r"\subsection*{Update stage, 50\%}" if latex else "### Update stage, 50%") in text
        assert text[1] == "" and len(text) == (35 if latex else 23)


# Results that were published or must come out so.
METRICS = {
    1: {"gsm8k": {"exact_match,flexible-extract": "0.41", "exact_match,strict-match": "0.39"},
        "minerva_math": {"math_verify,none": "0.125", "exact_match,none": "0.10"},
        "aime24": {"exact_match,none": "0.0333"}},
    2: {"gsm8k": {"exact_match,strict-match": "0.5"}},
    3: {"custom": {"acc,none": "0.25"}, "weird": {"stderr,none": "0.01"}},
    4: {"minerva_math": {"exact_match,none": "0.28"}, "minerva_math_algebra": {"exact_match,none": "0.30"},
        "minerva_math_precalc": {"exact_match,none": "0.10"}, "aime24": {"exact_match,none": "0.0"}},
    5: {"gsm8k": {"acc,none": "0.5"}, "gsm8kplus": {"acc,none": "0.4"}},
    6: {"t": {"exact_match,a": "N/A", "acc_b": "true", "acc_a": None}},
    7: {},
}
# Results that were published or must come out so.
HEADLINES = {
    (1, "gsm8k"): 41.0, (1, "minerva_math"): 12.5, (1, "aime24"): 3.33, (2, "gsm8k"): 50.0,
    (3, "custom"): 25.0, (4, "minerva_math"): 28.0, (4, "aime24"): 0.0, (5, "gsm8k"): 50.0,
    (5, "gsm8kplus"): 40.0, (6, "t"): 100.0,
}


def test_headline_metrics(spark):
    frame = spark.createDataFrame(list(METRICS.items()),
                                  "run_id long, results map<string,map<string,string>>")
    got = {(r.run_id, r.task): round(r.accuracy, 6) for r in ev.summarize_evals(frame).collect()}
    assert got == HEADLINES


# base batch, accumulation, G, P, allocate, processes -> k, m, per device, questions, micro-batch
# Results that were published or must come out so.
GEOMETRY = [
    (16, 8, 8, 0.0, True, 1, 8, 1, 16, 16, 16.0), (16, 8, 8, 0.5, True, 1, 4, 2, 32, 32, 16.0),
    (16, 8, 8, 0.75, True, 1, 2, 4, 64, 64, 16.0), (16, 8, 8, 0.875, True, 1, 1, 8, 128, 128, 16.0),
    (16, 8, 8, 0.75, False, 1, 2, 1, 16, 16, 4.0), (8, 4, 8, 0.75, True, 1, 2, 4, 32, 16, 8.0),
]


def run_table(spark, rows):
    columns = "base_batch int, accumulation int, group_size int, pruning_rate double, allocate boolean, processes int"
    return spark.createDataFrame(rows, columns).withColumn("run_id", F.monotonically_increasing_id())


def test_geometry(spark):
    runs = run_table(spark, [row[:6] for row in GEOMETRY])
    shaped = rn.with_geometry(runs).orderBy("run_id").collect()
    got = [(r.num_retained, r.allocation_multiplier, r.per_device_batch, r.questions_per_round,
            r.update_microbatch_per_device) for r in shaped]
    assert got == [row[6:] for row in GEOMETRY]


@pytest.mark.parametrize("row, message", [
    ((3, 1, 8, 0.0, True, 1), "not divisible"), ((8, 4, 8, 1.0, True, 1), "pruning_rate"),
    ((8, 4, 8, -0.1, True, 1), "pruning_rate"), ((8, 4, 0, 0.5, True, 1), "group_size"),
    ((0, 4, 8, 0.5, True, 1), "base_batch"), ((8, 0, 8, 0.5, True, 1), "accumulation"),
    ((8, 4, 8, 0.5, True, 0), "processes"), ((8, 4, None, 0.5, True, 1), "group_size is missing"),
])
def test_broken_runs(spark, row, message):
    runs = run_table(spark, [row])
    assert message in ";".join(rn.validate_runs(runs).first().violations)
    with pytest.raises(Exception, match=message):
        rn.with_geometry(runs).collect()
    assert rn.with_geometry(runs, "null").first().num_retained is None


def test_unknown_settings(spark):
    frame = spark.createDataFrame([(1, {"num_generations": "8", "typo_field": "1"})],
                                  "run_id long, settings map<string,string>")
    assert [r.key for r in rn.unknown_keys(rn.setting_keys(frame)).collect()] == ["typo_field"]


def test_timings(spark):
    rows = [(1, "train_step", 10.0, 0), (1, "rollout", 4.0, 8), (1, "loss", 0.0, 2),
            (2, "train_step", 1.0, 0), (2, "rollout", 1.5, 0), (3, "other", 1.0, 0)]
    events = spark.createDataFrame(rows, "run_id long, kind string, seconds double, completions long")
    got = {r.run_id: r for r in dg.stage_timings(events).collect()}
    assert (got[1].update_seconds, got[1].completion_retention) == (6.0, 0.25)
    assert got[1].seconds_per_updated_completion == 3.0
    assert (got[2].update_seconds, got[3].completion_retention, got[3].mean_rollout_seconds) == (0.0, 1.0, 0.0)


def test_length_gate(spark):
    ratios = spark.createDataFrame([(0.08,), (1.0,), (0.5,), (0.51,), (None,)], "clipped_ratio double")
    assert [r.status for r in rp.length_gate(ratios).collect()] == ["pass", "fail", "pass", "fail", "missing"]


def test_bench_points(spark):
    rows = [(1, 8, 0, 9.0, 5.0), (1, 8, 1, 1.0, 1.0), (1, 8, 2, 3.0, 1.0), (1, 4, 0, 9.0, 1.0), (1, 4, 1, 1.0, 2.0)]
    samples = spark.createDataFrame(rows, "bench_id long, num_retained int, step int, seconds double, memory_gib double")
    got = {r.num_retained: r for r in rn.speedups(rn.bench_points(samples, 1)).collect()}
    assert (got[8].mean_step_seconds, got[8].peak_memory_gib, got[4].stdev_step_seconds) == (2.0, 5.0, 0.0)
    assert (got[8].speedup, got[4].speedup) == (1.0, 2.0)
