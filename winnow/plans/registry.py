"""Where queries and their check SQL are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def r6(column: Column | str) -> Column:
    """A double rounded to six places, without negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """``r6`` on the named columns."""
    return df.withColumns({name: r6(f"`{name}`") for name in names})


def q6(expression: str, name: str) -> str:
    """The SQL counterpart of :func:`r6`."""
    return f'round(cast({expression} as double), 6) + cast(0 as double) as "{name}"'


def sql_text(text: str) -> str:
    """A text as an SQL expression; backslashes, quotes and line ends by their numbers."""
    parts = re.split(r"([\\\n'])", text)
    return " || ".join(f"chr({ord(part)})" if k % 2 else f"'{part}'" for k, part in enumerate(parts) if part)
