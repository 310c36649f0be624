"""Column helpers with the null rules of the library: missing is NULL, never NaN; no division or logarithm raises."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252


def series(symbol: str = "symbol", session: str = "session") -> WindowSpec:
    """The one partitioning and order of all time-series operators, so that Catalyst sorts once."""
    return Window.partitionBy(symbol).orderBy(session)


def trailing(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or either is missing."""
    return F.try_divide(a, b)


def log(x: Column) -> Column:
    """Natural logarithm, NULL for values of 0 and below."""
    return F.when(x > 0, F.log(x))


def lag(x: Column | str, k: int = 1) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.lag(x, k).over(series()) if k >= 0 else F.lead(x, -k).over(series())


def log_return(x: Column | str, k: int = 1) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return log(div(x, lag(x, k)))


def rolling(agg, x: Column | str, n: int, least: int | None = None) -> Column:
    """agg over the last n rows once there are `least` (n) values that are not missing among them."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(trailing(n)) >= (n if least is None else least), agg(x).over(trailing(n)))


def rolling_mean(x, n: int) -> Column:
    return rolling(F.avg, x, n)


def rolling_sd(x, n: int) -> Column:
    return rolling(F.stddev_samp, x, n)


def rolling_z(x, n: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return div(x - rolling_mean(x, n), rolling_sd(x, n))


def rolling_quantile(x, q: float, n: int, least: int) -> Column:
    return rolling(lambda v: F.percentile(v, F.lit(q)), x, n, least)


def flag(cond: Column) -> Column:
    """1 or 0; a missing condition is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """x within bounds; missing stays missing."""
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(lo))
    if hi is not None:
        y = F.least(y, F.lit(hi))
    return F.when(x.isNotNull(), y)


def sharpe(x: Column) -> Column:
    """Annualised mean over annualised deviation; NULL where the deviation is 0 or there are fewer than two values."""
    sd = F.when(F.stddev_samp(x) > 0, F.stddev_samp(x))
    return F.avg(x) / sd * F.sqrt(F.lit(float(TRADING_DAYS)))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation over the rows that have both; NULL where a side does not vary (Spark's corr raises there)."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return div(F.covar_pop(x, y), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
