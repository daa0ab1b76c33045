"""Per-group values on every row, and lookups, that survive hot keys.

A window over a group, or a join on a key, sends all rows of that key to one task.
Ordinary groups are small, so that is the cheapest plan: one exchange. A key with more
than ``hot_rows`` rows is handled apart, and exactly:

* its aggregate is computed with partial aggregation before the shuffle;
* its rows get a spread number, so the exchange divides them into pieces of about
  ``hot_rows`` rows instead of sending them to one task.

The hot keys are looked for when an operator is built, by one job that reads the key
columns only. Without any, the plan is one window or one join. Up to ``MOST_BROADCAST``
of them are broadcast with their aggregates; more are left to Catalyst's own sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 1_000_000
#: Hot keys up to this number, counted when the plan is built, are broadcast.
MOST_BROADCAST = 1_000
SPREAD = "_spread"
_HOT = "_hot"


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and their row counts as ``_rows``."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") > hot_rows)


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition &= F.col(f"{left}.`{key}`").eqNullSafe(F.col(f"{right}.`{key}`"))
    return condition


def _found(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, Callable] | None:
    """The hot keys and how to treat a side with a row for each, or None without any."""
    hot = hot_keys(df, keys, hot_rows)
    rows = hot.limit(MOST_BROADCAST + 1).collect()
    if not rows:
        return None
    if len(rows) > MOST_BROADCAST:
        return hot, lambda side: side
    return df.sparkSession.createDataFrame(rows, hot.schema), F.broadcast


def _mappable(kind: T.DataType) -> bool:
    """Whether a value can be hashed: maps, and what holds them, cannot."""
    return "map<" not in kind.simpleString() and not isinstance(kind, T.VariantType)


def _pieces(df: DataFrame, keys: Sequence[str], hot_rows: int) -> Column:
    """Spread number: 0 for ordinary rows, 1..pieces for rows of a hot key, by all columns."""
    identity = [F.col(f"`{f.name}`") for f in df.schema.fields
                if f.name not in (*keys, _HOT) and _mappable(f.dataType)]
    pieces = F.ceil(F.col(f"{_HOT}._rows") / hot_rows)
    spread = 1 + F.pmod(F.xxhash64(*identity), pieces) if identity else pieces
    return F.when(F.col(_HOT).isNotNull(), spread).otherwise(0).cast("int")


def _attach_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str], sized: Callable) -> DataFrame:
    """Add the hot row of each key as a struct column, NULL for ordinary keys."""
    values = [F.col(f"`{c}`") for c in hot.columns if c not in keys]
    packed = hot.select(*keys, F.struct(*values).alias(_HOT))
    joined = df.alias("l").join(sized(packed).alias("r"), _same(keys, "l", "r"), "left")
    return joined.select("l.*", F.col(f"r.{_HOT}"))


def with_group_stats(
    df: DataFrame,
    keys: Sequence[str],
    stats: dict[str, Column],
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add aggregates of each row's group as columns.

    Also adds ``_spread``; windows over :func:`group_window` reuse the same exchange.
    ``counted`` is a cheaper frame with the same keys, from which hot keys are found.
    """
    base = df.drop(SPREAD)
    found = _found(base if counted is None else counted, keys, hot_rows)
    if found is None:
        window = Window.partitionBy(*[F.col(f"`{key}`") for key in keys])
        valued = base.withColumns({name: value.over(window) for name, value in stats.items()})
        return valued.withColumn(SPREAD, F.lit(0))
    hot, sized = found
    only_hot = base.alias("l").join(sized(hot.select(*keys)).alias("r"), _same(keys, "l", "r"), "left_semi")
    hot_stats = only_hot.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[value.alias(name) for name, value in stats.items()]
    )
    marked = _attach_hot(base, hot_stats, keys, sized)
    marked = marked.withColumn(SPREAD, _pieces(marked, keys, hot_rows))
    window = group_window(keys)
    return marked.withColumns(
        {
            name: F.when(F.col(_HOT).isNotNull(), F.col(f"{_HOT}.`{name}`")).otherwise(
                value.over(window)
            )
            for name, value in stats.items()
        }
    ).drop(_HOT)


def group_window(keys: Sequence[str]) -> WindowSpec:
    """The window whose partitions are the ordinary groups of ``with_group_stats``."""
    return Window.partitionBy(*[F.col(f"`{key}`") for key in keys], F.col(SPREAD))


def lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join a table that has one row per key.

    Catalyst sizes the table. Rows of hot keys take their values from just those table
    rows, and the exchange spreads them, so no task receives a whole hot key.
    """
    names = [c for c in table.columns if c not in keys]
    kept = [F.col(f"l.`{c}`") for c in rows.columns if c not in names and c != SPREAD]
    found_keys = _found(rows, keys, hot_rows)
    if found_keys is None:
        joined = rows.alias("l").join(table.alias("r"), _same(keys, "l", "r"), "left")
        return joined.select(*kept, *[F.col(f"r.`{name}`").alias(name) for name in names])
    hot, sized = found_keys
    found = table.alias("l").join(sized(hot.select(*keys)).alias("r"), _same(keys, "l", "r"), "left_semi")
    hot_table = (
        hot.alias("l")
        .join(sized(found).alias("r"), _same(keys, "l", "r"), "left")
        .select("l.*", *[F.col(f"r.`{name}`") for name in names])
    )
    marked = _attach_hot(rows.drop(SPREAD), hot_table, keys, sized)
    marked = marked.withColumn(SPREAD, _pieces(marked, keys, hot_rows))
    plain = table.withColumn(SPREAD, F.lit(0))
    joined = marked.alias("l").join(
        plain.alias("r"),
        _same(keys, "l", "r") & (F.col(f"l.{SPREAD}") == F.col(f"r.{SPREAD}")),
        "left",
    )
    values = [
        F.when(F.col(f"l.{_HOT}").isNotNull(), F.col(f"l.{_HOT}.`{name}`"))
        .otherwise(F.col(f"r.`{name}`"))
        .alias(name)
        for name in names
    ]
    return joined.select(*kept, *values)
