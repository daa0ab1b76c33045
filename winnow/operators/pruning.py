"""Which completions take part in the update. WIN-2..5, WIN-7, FLT-2, FLT-5, JN-6."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import as_col
from .rounds import shuffle_key
from .scoring import GROUP
from .skew import HOT_ROWS, SPREAD, group_window, with_group_stats


def _ordering(order: str, keys: Sequence[str], seed: int) -> list[Column]:
    """Sort keys of a selector; ties go to the lower ``sample_idx``."""
    magnitude = F.abs("advantage").cast("float")
    position = F.col("sample_idx").asc()
    if order == "abs":
        return [magnitude.desc(), position]
    if order == "signed":
        return [F.col("advantage").cast("float").desc(), position]
    if order == "smallest":
        return [magnitude.asc(), position]
    if order == "random":
        return [shuffle_key(seed, *keys, "sample_idx").asc(), position]
    raise ValueError(f"unknown selector {order!r}")


def _with_rows(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    if "group_rows" in df.columns and SPREAD in df.columns:
        return df
    return with_group_stats(df, list(keys), {"group_rows": F.count(F.lit(1))}, hot_rows)


def _check_ragged(on_ragged: str) -> None:
    if on_ragged not in ("error", "keep", "keep_batch", "drop"):
        raise ValueError(f"on_ragged must be error, keep, keep_batch or drop, got {on_ragged!r}")


def _rank_window(keys: Sequence[str], group_size, whole: Column, hot_rows: int) -> WindowSpec:
    """Whole groups are ranked in one piece, whatever their size.

    Groups of more than ``hot_rows`` rows are spread. With a literal size of at most that
    they are never whole, and the exchange of the group's statistics serves the rank too.
    """
    if isinstance(group_size, int) and group_size <= hot_rows:
        return group_window(keys)
    piece = F.when(whole, 0).otherwise(F.col(SPREAD))
    return Window.partitionBy(*[F.col(f"`{key}`") for key in keys], piece)


def _per_batch(marked: DataFrame, batch: Sequence[str], name: str, value: Column) -> DataFrame:
    """Add an aggregate of each batch: one row per batch, which Catalyst sizes and joins."""
    named = {key: f"_batch{n}" for n, key in enumerate(batch)}
    rows = marked.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in named.items()]).agg(value.alias(name))
    same = F.lit(True)
    for key, other in named.items():
        same &= F.col(f"`{key}`").eqNullSafe(F.col(other))
    return marked.join(rows, same, "left").drop(*named.values())


def _ragged_error(keys: Sequence[str], group_size: Column) -> Column:
    names = [F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("NULL")) for key in keys]
    return F.raise_error(
        F.concat(
            F.lit("group "), F.concat_ws("/", *names), F.lit(" has "),
            F.col("group_rows").cast("string"), F.lit(" completions, expected "),
            group_size.cast("string"),
        )
    )


def select_topk(
    df: DataFrame,
    k: int,
    group_size: int,
    keys: Sequence[str] = GROUP,
    order: str = "abs",
    on_ragged: str = "error",
    seed: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """WIN-2, WIN-7, SRT-4. The ``k`` best completions of every whole group.

    With a literal ``k`` the filter sits on the ranking, so Spark limits each group
    before and after the exchange instead of ranking all rows.
    """
    _check_ragged(on_ragged)
    if not 1 <= k <= group_size:
        raise ValueError(f"k must lie in [1, {group_size}], got {k}")
    if on_ragged == "keep_batch":
        raise ValueError("keep_batch needs the batch keys of mark_kept")
    if on_ragged == "keep":
        marked = mark_kept(df, group_size, k, keys, order, on_ragged=on_ragged, seed=seed,
                           hot_rows=hot_rows)
        return marked.where("kept").drop("kept")
    sized = _with_rows(df, keys, hot_rows)
    whole = F.col("group_rows") == group_size
    if on_ragged == "error":
        whole = F.when(whole, True).otherwise(
            _ragged_error(keys, F.lit(group_size)).cast("boolean")
        )
    window = _rank_window(keys, group_size, F.col("group_rows") == group_size, hot_rows).orderBy(
        *_ordering(order, keys, seed))
    ranked = sized.where(whole).withColumn("_rank", F.row_number().over(window))
    return ranked.where(F.col("_rank") <= k).drop("_rank", SPREAD)


def group_topk(
    df: DataFrame,
    k: int | str | Column,
    keys: Sequence[str] = GROUP,
    order: str = "abs",
    seed: int = 0,
    most: int | None = None,
) -> DataFrame:
    """SRT-4, WIN-2. The ``k`` best rows of each group that already carry advantages; ``k`` may differ by run.

    Spark limits groups before an exchange only by a literal. So the largest ``k`` (``most``, or
    found by a job that reads ``k`` alone) limits every group on both sides of the exchange,
    and a row's own ``k`` then decides among the few that are left. A group of any size
    sends at most ``most`` rows per task.
    """
    bound = as_col(k)
    if most is None:
        most = k if isinstance(k, int) else df.agg(F.max(bound)).first()[0]
    if most is None or most < 1:
        return df.where(F.lit(False))
    window = Window.partitionBy(*[F.col(f"`{key}`") for key in keys]).orderBy(*_ordering(order, keys, seed))
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.where((F.col("_rank") <= most) & (F.col("_rank") <= bound)).drop("_rank")


def mark_kept(
    df: DataFrame,
    group_size: int | str | Column,
    k: int | str | Column,
    keys: Sequence[str] = GROUP,
    order: str = "abs",
    drop_zero: bool = False,
    zero_tolerance: float = 1e-8,
    batch: Sequence[str] | None = None,
    on_ragged: str = "error",
    training: Column | None = None,
    seed: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """WIN-2..5, FLT-5. Add ``kept`` to every row; ``group_size`` and ``k`` may be columns.

    ``drop_zero`` also drops advantages within ``zero_tolerance`` of 0. With ``batch``
    keys, a batch in which nothing would survive that falls back to the plain top-k.
    Ragged groups fail the job, are kept whole (with ``"keep_batch"`` the whole batch of a
    ragged group is), or are dropped. Rows where ``training`` is false are never pruned.
    """
    _check_ragged(on_ragged)
    if on_ragged == "keep_batch" and batch is None:
        raise ValueError("keep_batch needs batch keys")
    size, kept_per_group = as_col(group_size), as_col(k)
    sized = _with_rows(df, keys, hot_rows)
    whole = F.col("group_rows") == size
    if on_ragged == "drop":
        sized = sized.where(whole)
    window = _rank_window(keys, group_size, whole, hot_rows).orderBy(*_ordering(order, keys, seed))
    kept_whole = on_ragged in ("keep", "keep_batch")
    ragged = F.lit(True) if kept_whole else _ragged_error(keys, size).cast("boolean")
    marked = sized.withColumn("_rank", F.row_number().over(window)).withColumn(
        "kept", F.when(whole, F.col("_rank") <= kept_per_group).otherwise(ragged)
    )
    marked = marked.drop("_rank", SPREAD)
    strict = F.col("kept") & ((F.abs("advantage") > zero_tolerance) | ~whole) if drop_zero else None
    values = []
    if batch is not None and drop_zero:
        # What survives depends on the selector, so it is read from the marked rows.
        values.append(F.max(strict).alias("any"))
    if on_ragged == "keep_batch":
        values.append(F.max(~whole).alias("ragged"))
    if values:
        marked = _per_batch(marked, batch, "_of_batch", F.struct(*values))
    if drop_zero:
        chosen = strict if batch is None else F.when(F.col("_of_batch.any"), strict).otherwise(F.col("kept"))
        marked = marked.withColumn("kept", chosen)
    if on_ragged == "keep_batch":
        marked = marked.withColumn("kept", F.col("kept") | F.col("_of_batch.ragged"))
    marked = marked.drop("_of_batch")
    if training is not None:
        marked = marked.withColumn("kept", ~training | F.col("kept"))
    return marked


def prune(df: DataFrame, group_size, k, **options) -> DataFrame:
    """FLT-2. Keep the surviving rows with every column they have.

    Per-run scalars live in their own table and are joined afterwards.
    """
    plain = not {"drop_zero", "batch", "training"} & set(options)
    if plain and isinstance(k, int) and isinstance(group_size, int):
        return select_topk(df, k, group_size, **options)
    return mark_kept(df, group_size, k, **options).where("kept").drop("kept")


def apply_mask(df: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-6. Keep rows whose key is marked in a separate mask table.

    The mask names each completion once, so its keys are unique and never hot.
    """
    return df.join(mask.where("kept").select(*keys), list(keys), "left_semi")
