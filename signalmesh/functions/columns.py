"""Column expressions that stay inside Catalyst: average ranks, guarded correlation, lags by date distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def avg_rank(value: str, by: Sequence[str]) -> Column:
    """Rank within `by`; ties share the mean of their places (NULL for NULL).

    Both windows hash on `by` and sort once more on the value; no second exchange is needed.
    """
    first = F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), first + (ties - 1) / F.lit(2.0))


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation of a group; NULL where either side is constant."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def at_lag(value: str, lag: int, entity: str = "identifier", date: str = "date") -> Column:
    """The entity's value exactly `lag` date units earlier, by a RANGE frame (keys must be unique)."""
    w = Window.partitionBy(entity).orderBy(date)
    return F.max(value).over(w.rangeBetween(-lag, -lag)) if lag else F.col(value)


def interpolated(value: Column, curve: Sequence[float], low: float = 0.001, high: float = 0.999) -> Column:
    """Linear interpolation of a curve tabulated on an even grid, clamped outside."""
    n = len(curve)
    table = F.array(*[F.lit(float(x)) for x in curve])
    place = F.least(F.greatest((value - low) / ((high - low) / (n - 1)), F.lit(0.0)), F.lit(float(n - 1)))
    left = F.least(F.floor(place).cast("int"), F.lit(n - 2))
    a, b = F.element_at(table, left + 1), F.element_at(table, left + 2)
    return a + (b - a) * (place - left)


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
