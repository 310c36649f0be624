"""Performance metrics, benchmark weights, decomposition and regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as C

DAYS = float(C.TRADING_DAYS)


def equity_curve(df: DataFrame, total: str, by: list[str]) -> DataFrame:
    """equity (compounded 1 + total) and drawdown (from the highest equity so far, the first row's included)."""
    w = Window.partitionBy(*by).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    grown = df.withColumn("equity", F.product(1.0 + F.col(total)).over(w))
    return grown.withColumn("drawdown", C.div(F.col("equity"), F.max("equity").over(w)) - 1.0)


def performance(df: DataFrame, by: list[str], excess: str = "excess", total: str = "total", weight: str = "weight", gross: str | None = None) -> DataFrame:
    """One row of metrics for each key, from rows (by..., session, excess, total, weight); gross, the row's return, gives the hit rate."""
    w = Window.partitionBy(*by).orderBy("session")
    x, wt = F.col(excess), F.col(weight)
    rows = equity_curve(df, total, by).withColumn("__turn", F.coalesce(F.abs(wt - F.lag(wt).over(w)), F.lit(0.0)))
    down = F.when(x < 0, x)
    sd, down_sd = F.stddev_samp(x), F.stddev_samp(down)
    n = F.count(F.lit(1))
    hits = F.avg(F.when(wt != 0, (F.signum(wt) == F.signum(F.col(gross))).cast("double"))) if gross else F.lit(None).cast("double")
    out = rows.groupBy(*by).agg(
        n.alias("sessions"),
        F.round(n / DAYS, 2).alias("years"),
        (F.avg(x) * DAYS).alias("ann_mean_excess"),
        (F.avg(total) * DAYS).alias("ann_mean_total"),
        (sd * F.sqrt(F.lit(DAYS))).alias("ann_vol_excess"),
        C.sharpe(x).alias("sharpe_excess"),
        F.when((F.count(down) > 1) & (down_sd > 0), F.avg(x) * DAYS / (F.when(down_sd > 0, down_sd) * F.sqrt(F.lit(DAYS)))).alias("sortino_excess"),
        F.min("drawdown").alias("max_drawdown"),
        F.max_by("equity", "session").alias("terminal_wealth"),
        F.avg((wt != 0).cast("double")).alias("participation_rate"),
        F.avg(wt).alias("avg_net_exposure"),
        F.avg(F.abs(wt)).alias("avg_gross_exposure"),
        (F.avg("__turn") * DAYS).alias("turnover_per_year"),
        hits.alias("hit_rate_active"),
    )
    cagr = F.when(F.col("terminal_wealth") > 0, F.pow("terminal_wealth", DAYS / F.col("sessions")) - 1.0)
    out = out.withColumn("cagr_total", cagr)
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr_total") / F.abs("max_drawdown")))


def open_close_weights() -> dict[str, Column]:
    """Same-row benchmark weights, from lagged inputs; frame columns r_o2c and r_c2c are log returns."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    momentum = F.signum(C.lag(C.rolling(F.sum, "r_c2c", 5)))
    return {
        "cash": F.lit(0.0),
        "always_long": F.lit(1.0),
        "always_short": F.lit(-1.0),
        "prior_open_close": zero(F.signum(C.lag("r_o2c"))),
        "prior_close_close": zero(F.signum(C.lag("r_c2c"))),
        "momentum_5": zero(momentum),
        "reversal_5": zero(-momentum),
    }


def close_close_weights() -> dict[str, Column]:
    all_ = open_close_weights()
    return {"buy_and_hold": all_["always_long"]} | {k: all_[k] for k in ("prior_close_close", "momentum_5", "reversal_5")}


def long_weights(df: DataFrame, weights: dict[str, Column], keep: list[str]) -> DataFrame:
    """A row for each row of df and benchmark."""
    named = df.select(*keep, *(w.alias(f"__{k}") for k, w in weights.items()))
    return named.select(*keep, F.inline(F.array(*(F.struct(F.lit(k).alias("benchmark"), F.col(f"__{k}").alias("weight")) for k in weights))))


def breakeven_bps(w: Column, r: Column, financing: Column) -> Column:
    """The cost per side, in bp, at which the mean net return is 0; NULL without exposure."""
    exposure = F.avg(F.abs(w))
    return C.div(F.avg(w * r) - F.avg(financing * F.abs(w)), 2.0 * exposure) * 1e4


def decomposition(w: Column, r: Column, financing: Column, cost_bps: float) -> list[Column]:
    """Strategy less always-long: timing (w - 1) r, cost saving 2c (1 - |w|), financing saving f (1 - |w|); an exact identity."""
    idle = 1.0 - F.abs(w)
    timing, saving, fin = F.avg((w - 1.0) * r) * DAYS, F.avg(2.0 * cost_bps / 1e4 * idle) * DAYS, F.avg(financing * idle) * DAYS
    return [
        timing.alias("ann_gross_timing"), saving.alias("ann_cost_saving"), fin.alias("ann_financing_saving"),
        (timing + saving + fin).alias("ann_net_excess_vs_always_long")
    ]


def vol_matched(df: DataFrame, x: str, target: str, by: list[str]) -> Column:
    """x scaled so that its annual volatility is that of `target`, both over all rows of the key; unchanged where x has none."""
    w = Window.partitionBy(*by)
    own, aim = F.stddev_samp(x).over(w), F.stddev_samp(target).over(w)
    return F.when(own > 0, F.col(x) * aim / F.when(own > 0, own)).otherwise(F.col(x))


def tercile(x: str, by: list[str]) -> Column:
    """low, mid or high: right-closed thirds by interpolated quantiles over all rows of the key."""
    w = Window.partitionBy(*by)
    q1, q2 = F.percentile(x, F.lit(1 / 3)).over(w), F.percentile(x, F.lit(2 / 3)).over(w)
    return F.when(F.col(x) <= q1, "low").when(F.col(x) <= q2, "mid").when(F.col(x).isNotNull(), "high")


def regime_table(df: DataFrame, by: list[str], buckets: dict[str, Column], net: str = "net", weight: str = "weight") -> DataFrame:
    """by, dimension, bucket and participation, annual mean, Sharpe: all dimensions in one pass."""
    rows = df.select(
        *by, net, weight,
        F.inline(F.array(*(F.struct(F.lit(k).alias("dimension"), b.cast("string").alias("bucket")) for k, b in buckets.items())))
    )
    return rows.where("bucket IS NOT NULL").groupBy(*by, "dimension", "bucket").agg(
        F.count(F.lit(1)).alias("sessions"), F.avg(
            (F.col(weight) != 0).cast("double")
        ).alias("participation_rate"), (F.avg(net) * DAYS).alias("ann_mean"), C.sharpe(F.col(net)).alias("sharpe")
    )
