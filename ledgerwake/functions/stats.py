"""Statistics as Column expressions. A division by 0 gives null, as does a correlation without variance."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def finite(x: Column) -> Column:
    """Null in place of NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation over a group; null where either side is constant."""
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def t_stat(x: Column) -> Column:
    """Mean over its standard error, of the values that aren't null; null for fewer than two or for equal ones."""
    return F.when(F.min(x) < F.max(x), ratio(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))))


def t_stat_over(x: Column, w: WindowSpec) -> Column:
    return F.when(F.min(x).over(w) < F.max(x).over(w), ratio(F.avg(x).over(w), F.stddev_samp(x).over(w) / F.sqrt(F.count(x).over(w).cast("double"))))


def skewness(x: Column) -> Column:
    """Corrected for bias; null for fewer than three values."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    """Excess, corrected for bias; null for fewer than four values."""
    n = F.count(x).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def compound(growth: Column) -> Column:
    """Product of the growth factors."""
    return F.product(growth)


def power(x: Column, e: Column | float) -> Column:
    """Null where x is negative."""
    return F.when(x >= 0, F.pow(x, e if isinstance(e, Column) else F.lit(e)))


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank from 1 within the keys; ties share the mean of their ranks."""
    ordered, alike = Window.partitionBy(*keys).orderBy(x), Window.partitionBy(*keys, x)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(alike) - 1) / 2


def by_time() -> WindowSpec:
    return Window.partitionBy("run_id").orderBy("t_idx")


def by_asset() -> WindowSpec:
    return Window.partitionBy("run_id", "asset_idx").orderBy("t_idx")


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int) -> WindowSpec:
    return by_time().rowsBetween(-(n - 1), 0)
