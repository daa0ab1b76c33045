"""Shuffling, numbering and batching questions. SRT-1, SRT-2, WIN-8, WIN-9."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_col

BUCKET_DIGITS = 3


def shuffle_key(seed: int, *keys: str) -> Column:
    """Pseudo-random text that depends on the seed and key only, not on partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def shuffle_rows(df: DataFrame, seed: int | None, key: str) -> DataFrame:
    """SRT-1. Rows in a seeded order; without a seed the order is left alone."""
    if seed is None:
        return df
    return df.orderBy(shuffle_key(seed, key), key)


def cap(df: DataFrame, n: int | None) -> DataFrame:
    """SRT-2. The first ``n`` rows of a sorted frame: a top-n, not a full sort.

    Only for frames in an order; without one, partitioning would choose the rows.
    """
    return df if n is None else df.limit(n)


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Column, first: int | None = None
) -> DataFrame:
    """Number rows 0, 1, 2, ... within ``by`` without sorting a whole key in one task.

    ``bucket`` must never decrease along ``order`` and should divide the rows evenly:
    for a hashed order, the leading digits of the hash. Rows are counted per bucket, the
    counts become offsets, and only the rows of one bucket are ever sorted together.
    Adds ``row`` and ``total_rows``. With ``first`` only that many rows of a key come out:
    the offsets leave out buckets that begin later, so their rows are never sorted.
    """
    bucketed = df.withColumn("_bucket", bucket)
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"),
        F.sum("_count").over(Window.partitionBy(*by)).alias("total_rows"),
    )
    if first is not None:
        offsets = offsets.where(F.col("_offset") < first)
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = (
        bucketed.join(offsets, [*by, "_bucket"])
        .withColumn("row", F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_bucket", "_offset")
    )
    return numbered if first is None else numbered.where(F.col("row") < first)


def shuffled_sample(
    df: DataFrame, n: int, seed: int, key: str, bucket_digits: int = BUCKET_DIGITS
) -> DataFrame:
    """SRT-1, SRT-2. The first ``n`` rows of the seeded order, with their place as ``row``.

    Rows are numbered bucket by bucket, so no task sorts or holds the whole sample; those of
    buckets after the sample's last are dropped before the sort. Rows
    come in no order, whatever ``n`` is; sort by ``row`` to see the seeded one.
    """
    order = df.withColumn("_order", shuffle_key(seed, key))
    numbered = number_rows(
        order, [], [F.col("_order"), F.col(key)], F.substring("_order", 1, bucket_digits), n
    )
    return numbered.drop("_order", "total_rows")


def assign_rounds(
    df: DataFrame,
    questions_per_round: int | str | Column,
    by: Sequence[str] = ("run_id",),
    key: str = "group_id",
    seed: int = 42,
    bucket_digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """WIN-8. Put shuffled questions into rounds; the incomplete last round is dropped.

    One row per question. ``bucket_digits`` hex digits give ``16 ** digits`` buckets.
    """
    ordered = df.withColumn("_order", shuffle_key(seed, key))
    numbered = number_rows(
        ordered, by, [F.col("_order"), F.col(key)], F.substring("_order", 1, bucket_digits)
    )
    per_round = as_col(questions_per_round)
    return (
        numbered.withColumn("round", F.floor(F.col("row") / per_round))
        .where(F.col("round") < F.floor(F.col("total_rows") / per_round))
        .drop("_order", "total_rows")
    )


def assign_microbatches(
    df: DataFrame,
    steps: int | Column,
    round_keys: Sequence[str] = ("run_id", "round"),
    order: Sequence[str] = ("group_id", "sample_idx"),
) -> DataFrame:
    """WIN-9. Split a round's retained rows into equal micro-batches, remainder dropped.

    A round holds at most ``questions_per_round * k`` rows, so its window is bounded.
    """
    whole = Window.partitionBy(*round_keys)
    rank = F.row_number().over(whole.orderBy(*order)) - 1
    size = F.floor(F.count(F.lit(1)).over(whole) / as_col(steps))
    return (
        df.withColumn("_rank", rank)
        .withColumn("_size", size)
        .where(F.col("_rank") < F.col("_size") * as_col(steps))
        .withColumn("microbatch", F.floor(F.col("_rank") / F.col("_size")).cast("int"))
        .drop("_rank", "_size")
    )
