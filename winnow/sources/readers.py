"""Readers. SRC-1..6."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_problems(
    spark: SparkSession,
    path: str,
    prompt: str = "prompt",
    solution: str = "solution",
    key: str = "problem_id",
    file_format: str = "parquet",
) -> DataFrame:
    """SRC-1, PRJ-5. A problem corpus as ``problem_id, prompt, solution``.

    The arguments name the source columns; no other column is read.
    """
    source = spark.read.format(file_format).load(path)
    return source.select(
        F.col(key).cast("bigint").alias("problem_id"),
        F.col(prompt).alias("prompt"),
        F.col(solution).cast("string").alias("solution"),
    )


def read_rollouts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2. Rollouts, one row per completion, partitioned by ``run_id`` on disk."""
    return spark.read.parquet(path)


def write_rollouts(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write rollouts partitioned by run, so a filter on ``run_id`` prunes files.

    Rows are dealt out by run first, large runs over several tasks, so a run has few files.
    """
    df.hint("rebalance", "run_id").write.mode(mode).partitionBy("run_id").parquet(path)


_CLUSTERING = "buckets int, keys array<string>, columns string"


def write_clustered(
    df: DataFrame, path: str, buckets: int, keys: Sequence[str] = ("run_id", "group_id"), mode: str = "errorifexists"
) -> None:
    """SRC-2. Rollouts in buckets of their groups, so that what works per group needs no shuffle.

    Written once by one shuffle, read by :func:`read_clustered` as often as needed. The
    folder says how it is clustered. A bucket is read by one task: choose ``buckets`` so that
    one fits, and leave runs with a group of a third of all rows to :func:`write_rollouts`.
    """
    spark, name = df.sparkSession, f"winnow_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the data is the path's; only the entry goes
    entry = spark.createDataFrame([(buckets, list(keys), df._jdf.schema().toDDL())], _CLUSTERING)
    entry.coalesce(1).write.mode("overwrite").json(f"{path}/_clustering")


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2. Clustered rollouts; aggregates, windows and joins on their keys keep the buckets.

    The session's catalog gets an entry for the path, as only tables carry buckets.
    """
    how = spark.read.schema(_CLUSTERING).json(f"{path}/_clustering").first()
    name = f"winnow_clustered_{hashlib.md5(path.encode()).hexdigest()}"
    keys = ", ".join(f"`{key}`" for key in how.keys)
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({how.columns}) USING parquet CLUSTERED BY ({keys}) "
              f"SORTED BY ({keys}) INTO {how.buckets} BUCKETS LOCATION '{location}'")
    return spark.table(name)


def _read_json(
    spark: SparkSession, path: str, schema: T.StructType, whole_files: bool
) -> DataFrame:
    """JSON objects, one per file or one per line; anything else fails the job."""
    text = spark.read.text(path, wholetext=whole_files).select(
        F.col("value"), F.col("_metadata.file_path").alias("source_file")
    )
    checked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = text.where(F.trim("value") != "").withColumn(
        "_json",
        F.from_json("value", checked, {"columnNameOfCorruptRecord": "_corrupt"}),
    )
    is_object = F.regexp_like("value", F.lit(r"^\s*\{")) & F.col("_json._corrupt").isNull()
    failure = F.raise_error(
        F.concat(F.col("source_file"), F.lit(" does not contain a JSON object"))
    )
    valid = parsed.where(F.when(is_object, True).otherwise(failure.cast("boolean")))
    return valid.select(*[F.col(f"_json.`{f.name}`") for f in schema.fields], "source_file")


def read_profiles(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """SRC-3. Run profiles, one JSON object per file (or per line)."""
    return _read_json(spark, path, schemas.PROFILE, whole_files)


def read_evals(
    spark: SparkSession, path: str, summary_field: str = "summary", whole_files: bool = True
) -> DataFrame:
    """SRC-4. Evaluation payloads; ``summary_field`` names the stored accuracies."""
    payload = _read_json(spark, path, schemas.evaluation(summary_field), whole_files)
    return payload.withColumnRenamed(summary_field, "accuracies")


def read_benchmarks(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """SRC-5. Update-stage benchmark points, in their order within the payload."""
    payload = _read_json(spark, path, schemas.BENCHMARK, whole_files)
    values = [c for c in payload.columns if c != "results"]
    points = payload.select(*values, F.posexplode("results").alias("position", "point"))
    return points.select(*values, "position", "point.*")


def read_logs(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """SRC-6. Training logs, one row per file (or per line), as ``source_file, value``."""
    logs = spark.read.text(path, wholetext=whole_files)
    return logs.select(F.col("_metadata.file_path").alias("source_file"), "value")


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6. The lines of training logs as ``source_file, position, value``; files of any size are split.

    ``position``, a number, orders the lines of a file: by the split's offset, then as they
    are read. Line ends are those of the text source; a line, not a file, must fit a task.
    Spark skips empty files, here and in ``read_logs``.
    """
    block = F.col("_metadata.file_block_start").cast("decimal(19,0)")
    line = F.monotonically_increasing_id().cast("decimal(19,0)")
    at = (block * F.lit(Decimal(10**19)) + line).cast("decimal(38,0)")
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), at.alias("position"), "value")
