"""Writers and the shared scratch folder. SNK-1..3."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.cache
def _own_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="winnow-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    A local session without that setting uses one temporary folder of this process, which
    goes when the process ends; any other session must have the setting.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = _own_folder().name
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_reports(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """SNK-1. One JSON object per row; parent folders are created."""
    df.write.mode(mode).json(path)
    return path


def write_text(rendered: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """SNK-2. Rendered lines as text; part files are in reading order."""
    rendered.select("line").write.mode(mode).text(path)
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except Exception as error:  # noqa: BLE001 - Spark reports a missing path only this way
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def write_once(df: DataFrame, path: str, key: str = "run_id") -> str:
    """SNK-3. Resumable write: runs that are already stored are skipped.

    A run counts as stored once ``_finished`` names it, which is written after its data. A
    run that a failed job left half-written is replaced by the next attempt. Only the list
    of finished runs is read to find what is missing.
    """
    spark, finished = df.sparkSession, f"{path}/_finished"
    kind = df.schema[key].dataType
    missing = df
    if _exists(spark, finished):
        stored = spark.read.schema(T.StructType([T.StructField(key, kind)])).parquet(finished)
        missing = df.join(stored, key, "left_anti")
    keys = missing.select(key).distinct().persist()
    keys.count()  # what this call writes, as it is before it is written
    missing.hint("rebalance", key).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    keys.write.mode("append").parquet(finished)
    keys.unpersist()
    return path


_MANIFEST = "name string, folder string, attempt string"


def commit(df: DataFrame, path: str, name: str, partition_by: Sequence[str] = ()) -> bool:
    """Write rows as a named commit, once: data to a new folder, then a manifest that names it.

    A commit of that name that is already there is left alone, and false comes back. An
    attempt that dies before its manifest leaves a folder that :func:`read_committed` never opens.
    """
    spark, manifest, attempt = df.sparkSession, f"{path}/_commits/{name}", uuid.uuid4().hex
    if _exists(spark, manifest) and not spark.read.schema(_MANIFEST).json(manifest).isEmpty():
        return False
    df.write.partitionBy(*partition_by).parquet(f"{path}/data/{name}-{attempt}")
    _write_manifest(spark, manifest, (name, f"data/{name}-{attempt}", attempt))
    return True


def _write_manifest(spark: SparkSession, manifest: str, entry: tuple) -> None:
    spark.createDataFrame([entry], _MANIFEST).coalesce(1).write.mode("overwrite").json(manifest)


def read_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all commits under a path, in the schema they were written with."""
    names = [f.name for f in schema.fields]
    if not _exists(spark, f"{path}/_commits"):
        return spark.createDataFrame([], schema)
    entries = spark.read.schema(_MANIFEST).json(f"{path}/_commits/*").where("folder is not null")
    folders = [f"{path}/{row.folder}" for row in entries.select("folder").collect()]  # one a commit
    if not folders:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(folder).select(*names) for folder in folders]
    return functools.reduce(DataFrame.unionByName, parts)
