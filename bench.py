"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores.
Every query is run twice and written to Spark's no-op sink; the second run counts, so
the numbers hold planning and execution but not JVM start. Rows per second of scoring
and pruning, and of box extraction native against a Python UDF, go to ``rates``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from winnow.functions.text import extract_boxed  # noqa: E402
from winnow.operators.diagnostics import summarize_pruning  # noqa: E402
from winnow.operators.pruning import mark_kept, select_topk  # noqa: E402
from winnow.operators.scoring import group_advantage, score  # noqa: E402
from winnow.plans import views  # noqa: E402
from winnow.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "str_1_extract_boxed", "str_11_score", "jn_1_attach_solutions", "win_1_group_advantage",
    "win_2_select_topk", "win_4_batch_fallback", "agg_1_summarize_pruning",
    "agg_13_reward_metrics", "agg_14_length_metrics", "agg_16_outcome_mix",
    "win_8_assign_rounds", "obj_2_group_objective", "obj_3_dapo_loss", "obj_7_objective_grid",
    "flt_1_prompt_length", "mth_3_with_geometry", "agg_4_stage_timings", "agg_9_collapse_groups",
    "agg_12_linear_fit", "rpt_1_performance_table", "rpt_3_benchmark_table", "stm_2_prune_stream",
)


#: For what queries write in between; goes when the benchmark ends.
SCRATCH = tempfile.TemporaryDirectory(prefix="winnow-bench-")


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("winnow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # Call-site capture costs a round trip per column function while a plan is built.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", SCRATCH.name)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


@F.pandas_udf(T.StringType())
def python_boxed(texts: pd.Series) -> pd.Series:
    """The plain loop that the native expression is measured against."""

    def last(text):
        """One pass over the braces; what is open stands on a stack, a plain brace as None."""
        waiting, best = [], (-1, None)
        for token in re.finditer(r"\\boxed\{|[{}]", text or ""):
            if token[0] != "}":
                waiting.append(token.end() if len(token[0]) > 1 else None)
            elif waiting and (begin := waiting.pop()) is not None:
                best = max(best, (begin, text[begin:token.start()]))
        return best[1]

    return texts.map(last)


def rates(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Rows per second over sixteen copies of the events, cached before timing."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("copy")
    events = views.table(spark, sf_dir, "events").select("*", copies)
    events = events.withColumn("event_id", F.col("event_id") * 16 + F.col("copy")).drop("copy")
    rollouts = views.rollouts_of(events.repartition(spark.sparkContext.defaultParallelism)).cache()
    rows = rollouts.count()
    pruned = group_advantage(score(rollouts))
    runs = {
        "score": score(rollouts).select("reward"),
        "advantage_and_prune": select_topk(pruned, 2, 8).select("group_id", "sample_idx", "advantage"),
        "pruning_summary": summarize_pruning(mark_kept(pruned, 8, 2)),
        "extract_boxed_native": rollouts.select(extract_boxed("completion").alias("b")),
        "extract_boxed_udf": rollouts.select(python_boxed("completion").alias("b")),
    }
    found = {}
    for name, frame in runs.items():
        drain(frame)
        found[name] = round(rows / timed(lambda frame=frame: drain(frame)))
    rollouts.unpersist()
    return found


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    seconds = {}
    for name in HEADLINE:
        run = lambda name=name: drain(QUERIES[name](spark, sf_dir))
        run()
        seconds[name] = round(timed(run), 3)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "rates": rates(spark, sf_dir),
        "rates_unit": "rows/sec",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
