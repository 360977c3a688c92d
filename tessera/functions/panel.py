"""Column builders for panels: rolling, lagged and cross-sectional expressions over a ticker's or a date's rows.

Missing values are NULL. A rolling result is NULL unless its whole window is there (min_periods = n).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def running(over: WindowSpec | None = None) -> WindowSpec:
    return (over or by_ticker()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_rows(n: int, over: WindowSpec | None = None) -> WindowSpec:
    return (over or by_ticker()).rowsBetween(1 - n, 0)


def rolling(agg: Callable[..., Column], *x: Column, n: int, over: WindowSpec | None = None, least: int | None = None) -> Column:
    """agg of the last n rows, NULL where fewer than `least` (n by default) of them have all arguments."""
    frame, least = last_rows(n, over), n if least is None else least
    there = F.lit(True)
    for c in x:
        there = there & c.isNotNull()
    return F.when(F.count(F.when(there, 1)).over(frame) >= least, agg(*x).over(frame))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.when(b != 0, b)


def change(x: Column, rows: int, over: WindowSpec | None = None) -> Column:
    """Relative change against `rows` rows before."""
    return ratio(x, F.lag(x, rows).over(over or by_ticker())) - 1


def padded(x: Column, over: WindowSpec | None = None) -> Column:
    """The last known value."""
    return F.last(x, ignorenulls=True).over(over or running())


def filled(x: Column, rows: int, over: WindowSpec | None = None) -> Column:
    """x, or its last value of at most `rows` rows before."""
    return F.last(x, ignorenulls=True).over((over or by_ticker()).rowsBetween(-rows, 0))


def slope(x: Column, n: int, order: Column, over: WindowSpec | None = None) -> Column:
    """Least-squares slope of x on row number over the last n rows; order: the ticker's row numbers."""
    frame = last_rows(n, over)
    return F.when(F.count(x).over(frame) == n, F.regr_slope(x, order.cast("double")).over(frame))


def annualised(deviation: Column) -> Column:
    return deviation * math.sqrt(252)


def zscore(x: Column, *by: str) -> Column:
    """Distance from the group's mean in population deviations; 0 where the deviation is unknown, 0 or only rounding."""
    w = Window.partitionBy(*by)
    deviation, mean = F.stddev_pop(x).over(w), F.avg(x).over(w)
    return F.when(deviation > 1e-12 * F.abs(mean), (x - mean) / deviation).otherwise(F.lit(0.0))


def imputed(x: Column, *by: str) -> Column:
    """x, or its group's median."""
    return F.coalesce(x, F.median(x).over(Window.partitionBy(*by)))


def share_rank(x: Column, *by: str) -> Column:
    """Rank among the group's known values as a share of them; ties share the mean of their ranks."""
    w = Window.partitionBy(*by, x.isNull()).orderBy(x)
    n = F.count(x).over(Window.partitionBy(*by, x.isNull()))
    return F.when(x.isNotNull(), (F.rank().over(w) / n + F.cume_dist().over(w)) / 2)


def failing(flag: Column) -> Column:
    """An unknown quality flag counts as failing."""
    return F.coalesce(flag, F.lit(True))
