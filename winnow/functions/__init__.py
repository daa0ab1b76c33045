"""Column builders. Everything here is native Spark expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """A Column as is, a string as a column name, anything else as a literal."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it.

    Keeps nested column builders linear in size. Operators on a hot path add the value
    as a column of its own instead, which stays in generated code.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
