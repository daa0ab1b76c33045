"""Cell formats of report tables. STR-14, STR-15."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col

# LaTeX escapes, applied in this order.
LATEX_ESCAPES = (
    ("\\", r"\textbackslash{}"),
    ("&", r"\&"),
    ("%", r"\%"),
    ("$", r"\$"),
    ("#", r"\#"),
    ("_", r"\_"),
    ("{", r"\{"),
    ("}", r"\}"),
    ("~", r"\textasciitilde{}"),
    ("^", r"\textasciicircum{}"),
    ("+/-", r"$\pm$"),
)


def fixed(value, digits: int = 2, dash: str = "--") -> Column:
    """STR-14. A number with fixed digits, ``--`` for NULL.

    ``format_number`` rounds the exact binary value, half to even;
    ``format_string`` would round the shortest decimal text half up instead.
    """
    pattern = "0" if digits == 0 else "0." + "0" * digits
    text = F.call_function("format_number", as_col(value).cast("double"), F.lit(pattern))
    return F.coalesce(text, F.lit(dash))


def percent(share, digits: int = 2) -> Column:
    """STR-14. A share as percent."""
    return F.concat(fixed(100 * as_col(share), digits), F.lit("%"))


def times(value, digits: int = 2) -> Column:
    """STR-14. A factor such as ``1.51x``; ``--x`` for NULL."""
    return F.concat(fixed(value, digits), F.lit("x"))


def plus_minus(mean, deviation, digits: int = 4) -> Column:
    """STR-14. ``mean +/- deviation``."""
    return F.concat(fixed(mean, digits), F.lit(" +/- "), fixed(deviation, digits))


def latex_escape(text) -> Column:
    """STR-15. A cell that LaTeX prints as written."""
    escaped = as_col(text)
    for plain, replacement in LATEX_ESCAPES:
        escaped = F.replace(escaped, F.lit(plain), F.lit(replacement))
    return escaped
