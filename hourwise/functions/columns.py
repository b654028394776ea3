"""Small Column helpers shared by the operators.

All of them build built-in Catalyst expressions (no Python UDFs), so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` with NULL for a zero or NULL divisor (as in the original; ANSI Spark would raise)."""
    return F.try_divide(col(num), col(den))


def pct(num: str | Column, den: str | Column, digits: int = 1) -> Column:
    """``ROUND(num * 100.0 / den, digits)``; NULL when ``den`` is 0."""
    return F.round(F.try_divide(col(num) * F.lit(100.0), col(den)), digits)


def growth_pct(cur: str | Column, prev: str | Column, digits: int = 1) -> Column:
    """``ROUND((cur - prev) / prev * 100, digits)``; NULL without a previous value."""
    return F.round(F.try_divide(col(cur) - col(prev), col(prev)) * F.lit(100), digits)


# Aggregate helpers take a column *name* and return one SQL expression: built in a single
# call to the JVM instead of one call per nested function (plan-construction cost).
def count_all() -> Column:
    """``COUNT(*)``."""
    return F.expr("count(1)")


def avg1(c: str = "traffic_count") -> Column:
    """``ROUND(AVG(c), 1)``."""
    return F.expr(f"round(avg({c}), 1)")


def std1(c: str = "traffic_count") -> Column:
    """``ROUND(STD(c), 1)``: the original's ``STD`` is the population standard deviation."""
    return F.expr(f"round(stddev_pop({c}), 1)")


def sum_long(c: str) -> Column:
    """``SUM(c)`` as BIGINT."""
    return F.expr(f"CAST(sum({c}) AS BIGINT)")


def flag(cond: Column) -> Column:
    """0/1 integer flag (kept numeric because the flags are summed)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def label_if(cond: Column, yes: str, no: str) -> Column:
    return F.when(cond, F.lit(yes)).otherwise(F.lit(no))


def hour_label(hour: str | Column = "hour_of_day", named: bool = True) -> Column:
    """12-hour clock label: ``12 AM``, ``1 AM`` ... ``11 PM``.

    With ``named`` the two special hours read ``12 AM (Midnight)`` / ``12 PM (Noon)``
    (the hourly-pattern query); the hourly-pattern view uses the short form.
    """
    h = col(hour)
    midnight = "12 AM (Midnight)" if named else "12 AM"
    noon = "12 PM (Noon)" if named else "12 PM"
    return (
        F.when(h == 0, F.lit(midnight))
        .when(h < 12, F.concat(h.cast("string"), F.lit(" AM")))
        .when(h == 12, F.lit(noon))
        .otherwise(F.concat((h - 12).cast("string"), F.lit(" PM")))
    )


BAR_CHAR = "█"  # full block, one per ``bar_unit`` visits


def text_bar(value: str | Column, unit: int) -> Column:
    """``RPAD('', ROUND(value / unit), '█')``: a text bar chart cell."""
    n = F.round(col(value) / F.lit(float(unit))).cast("int")
    return F.repeat(F.lit(BAR_CHAR), n)


def field_position(c: str | Column, values: Sequence[str]) -> Column:
    """``FIELD(c, v1, v2, ...)``: 1-based position in ``values``, 0 when absent."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), col(c))

