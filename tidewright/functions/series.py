"""Null-safe algebra of ordered series: columns over a table of (symbol, ts), all windows of one partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-8
KEYS = ("symbol", "ts")


def ordered() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def frame(n: int, lag: int = 0) -> WindowSpec:
    """The n rows that end `lag` rows before the current one."""
    return ordered().rowsBetween(-(n - 1) - lag, -lag)


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(x, k).over(ordered())


def delta(x: str | Column, k: int = 1) -> Column:
    return F.col(x) - lag(x, k) if isinstance(x, str) else x - lag(x, k)


def rolled(agg, x: str | Column, n: int, lag: int = 0) -> Column:
    """agg of the last n values, null unless all n are there."""
    w = frame(n, lag)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def both_max(a: Column, b: Column) -> Column:
    """The greater, null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def both_min(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def floored(x: Column, least: float = 0.0) -> Column:
    return both_max(x, F.lit(float(least)))


def zero(x: str | Column) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0.0))


def skew(x: str, n: int) -> Column:
    """Bias-corrected skewness of the last n values."""
    return rolled(F.skewness, x, n) * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurt(x: str, n: int) -> Column:
    """Bias-corrected excess kurtosis of the last n values."""
    return ((n + 1) * rolled(F.kurtosis, x, n) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def correlation(a: str | Column, b: str | Column, w: WindowSpec | None = None) -> Column:
    """Pearson's coefficient over a window or group; null, not an error, where either is constant."""
    over = (lambda x: x.over(w)) if w is not None else (lambda x: x)
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    spread = [over(F.stddev_pop(F.when(both, x))) for x in (a, b)]
    return ratio(over(F.covar_pop(a, b)), spread[0] * spread[1])


def pct_rank(x: str, n: int) -> Column:
    """Rank of the last of n values among them as a share, ties at their mean."""
    values = F.collect_list(x).over(frame(n))
    less = F.size(F.filter(values, lambda v: v < F.col(x)))
    same = F.size(F.filter(values, lambda v: v == F.col(x)))
    return F.when(F.count(x).over(frame(n)) == n, (less + (same + 1) / 2) / n)


def staged(df: DataFrame, *levels) -> DataFrame:
    """Adds columns level by level; a level may use those before it. A level is {name: column}, or a function of df for what
    columns can't express. All windows between two such share one exchange and sort."""
    return reduce(lambda d, level: level(d) if callable(level) else d.withColumns(level), levels, df)
