"""One query for each feature group, and queries for the window primitives under them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions.quantiles import expanding_quantiles
from ..functions.smoothing import smooth
from ..operators import features as X
from .base import BARS, SNAPSHOT, market_bars, query, rnd, rounded, snapshot

W = "PARTITION BY symbol ORDER BY session"


def full(agg: str, x: str, n: int, least: int | None = None) -> str:
    """SQL of a rolling aggregate with enough values in its window."""
    o = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {o} >= {least or n} THEN {agg.format(x)} {o} END"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def log_ret(x: str, k: int = 1) -> str:
    r = ratio(x, f"lag({x}, {k}) OVER ({W})")
    return f"CASE WHEN {r} > 0 THEN ln({r}) END"


def z(x: str, n: int) -> str:
    return ratio(f"{x} - ({full('avg({})', x, n)})", full("stddev_samp({})", x, n))


def _flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1 ELSE 0 END"


VOL = "CAST(volume AS DOUBLE)"
EXPR: dict[str, dict[str, str]] = {
    "lagged_return": {"log_ret": "_ret"} | {f"ret_lag_{k}": log_ret("close", k) for k in X.RETURN_LAGS},
    "trend": {f"SMA_gap_{w}": ratio(f"close - ({full('avg({})', 'close', w)})", full("avg({})", "close", w)) for w in X.SMA_WINDOWS},
    "volatility": {f"Volatility_{w}": full("stddev_samp({})", "_ret", w) for w in X.VOL_WINDOWS},
    "bollinger": {
        "BB_width": ratio(f"4 * ({full('stddev_samp({})', 'close', 20)})", full("avg({})", "close", 20)),
        "BB_percent_b": ratio(
            f"close - (({full('avg({})', 'close', 20)}) - 2 * ({full('stddev_samp({})', 'close', 20)}))",
            f"4 * ({full('stddev_samp({})', 'close', 20)})"
        ),
    },
    "macro_change": {"VIX": "vix"} | {
        f"{s.upper()}_ret_{k}": log_ret(s, k) for s in ("vix", "dxy", "oil") for k in X.MACRO_LAGS
    } | {f"TNX_change_{k}": f"tnx - lag(tnx, {k}) OVER ({W})" for k in X.MACRO_LAGS},
    "macro_zscore": {f"{s.upper()}_z_{w}": z(s, w) for s in ("vix", "dxy", "tnx", "oil") for w in X.Z_WINDOWS},
    "yield_curve": {"YC_2Y10Y_change_1": f"_spread - lag(_spread) OVER ({W})"} | {f"YC_2Y10Y_z_{w}": z("_spread", w) for w in X.Z_WINDOWS},
    "intraday": {
        "intraday_ret": "CASE WHEN close / nullif(open, 0) > 0 THEN ln(close / nullif(open, 0)) END",
        "overnight_gap": f"CASE WHEN open / nullif(lag(close) OVER ({W}), 0) > 0 THEN ln(open / nullif(lag(close) OVER ({W}), 0)) END",
        "high_low_range": ratio("high - low", "close"),
        "close_location_value": ratio("close - low", "high - low"),
    },
    "volume": {"relative_volume_20": ratio(VOL, full("avg({})", VOL, 20)), "volume_z_20": "_vz", "volume_ret_interaction": "_vz * _ret"},
    "calendar": {
        "is_monday": _flag("isodow(session) = 1"),
        "is_friday": _flag("isodow(session) = 5"),
        "is_month_start": _flag("session = min(session) OVER (PARTITION BY symbol, date_trunc('month', session))"),
        "is_month_end": _flag("session = max(session) OVER (PARTITION BY symbol, date_trunc('month', session))"),
    },
    "regime": {
        "vix_regime_high": _flag(f"vix > ({full('quantile_cont({}, 0.75)', 'vix', 252, 60)})"),
        "vix_regime_low": _flag(f"vix < ({full('quantile_cont({}, 0.25)', 'vix', 252, 60)})"),
    },
    "cross_market": {f"{s.upper()}_ret_{k}": log_ret(f"{s}_close", k) for s in ("qqq", "iwm", "dia") for k in X.STYLE_LAGS},
}
BASE = f"{SNAPSHOT}, base AS (SELECT *, {log_ret('close')} AS _ret, {z(VOL, 20)} AS _vz, lag(dgs10 - dgs2) OVER ({W}) AS _spread FROM snap)"


def features_sql(columns: dict[str, str], base: str = BASE) -> str:
    return f"{base}, feats AS (SELECT symbol, session, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM base)"


def _z_digits(group: str) -> int:
    return 6


def _group_query(group: str):
    columns, registry = EXPR[group], X.Registry([f for f in X.REGISTRY.features if f.group == group])
    ints = group in ("calendar", "regime")
    sql = f"WITH {features_sql(columns)} SELECT symbol, session, {', '.join(columns) if ints else rnd(*columns, digits=6)} FROM feats"

    @query(f"features_{group}", sql)
    def run(spark, sf):
        return rounded(X.build(snapshot(spark, sf), registry), 6)


for _g in EXPR:
    _group_query(_g)


# exponential means are recursive; the SQL follows the rows one by one
_EWM = f"""
WITH RECURSIVE {SNAPSHOT},
d AS (SELECT symbol, session, close, close - lag(close) OVER ({W}) AS delta, row_number() OVER ({W}) AS rn FROM snap),
e AS (
  SELECT symbol, session, rn, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS m9 FROM d WHERE rn = 1
  UNION ALL
  SELECT d.symbol, d.session, d.rn, CASE WHEN e.g IS NULL THEN greatest(d.delta, 0) ELSE (13.0::DOUBLE * e.g + greatest(d.delta, 0)) / 14 END,
    CASE WHEN e.l IS NULL THEN -least(d.delta, 0) ELSE (13.0::DOUBLE * e.l - least(d.delta, 0)) / 14 END,
    (11.0::DOUBLE * e.e12 + 2 * d.close) / 13, (25.0::DOUBLE * e.e26 + 2 * d.close) / 27,
    0.8::DOUBLE * e.m9 + 0.2::DOUBLE * ((11.0::DOUBLE * e.e12 + 2 * d.close) / 13 - (25.0::DOUBLE * e.e26 + 2 * d.close) / 27)
  FROM e JOIN d ON d.symbol = e.symbol AND d.rn = e.rn + 1)
"""
EWM_STEPS = _EWM.split(SNAPSHOT)[1].rstrip()


@query(
    "features_momentum",
    f"""{_EWM} SELECT symbol, session, round(CASE WHEN rn < 15 THEN NULL WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0 END, 6) + 0.0 AS RSI_14, round(e12 - e26 - m9, 4) + 0.0 AS MACD_hist FROM e""",
)
def features_momentum(spark, sf):
    r = X.Registry([f for f in X.REGISTRY.features if f.group == "momentum"])
    out = X.build(snapshot(spark, sf), r)
    return out.select("symbol", "session", (F.round("RSI_14", 6) + 0.0).alias("RSI_14"), (F.round("MACD_hist", 4) + 0.0).alias("MACD_hist"))


@query(
    "ewm_rsi",
    f"{_EWM} SELECT symbol, session, round(CASE WHEN rn >= 15 THEN g END, 5) + 0.0 AS avg_gain, round(CASE WHEN rn >= 15 THEN l END, 5) + 0.0 AS avg_loss FROM e"
)
def ewm_rsi(spark, sf):
    d = snapshot(spark, sf).select("symbol", "session", (F.col("close") - C.lag("close")).alias("delta")).select(
        "symbol", "session", C.clip(F.col("delta"), lo=0.0).alias("gain"),
        (-C.clip(F.col("delta"), hi=0.0)).alias("loss")
    )
    return rounded(smooth(d, {"avg_gain": ("gain", 1 / 14, 14), "avg_loss": ("loss", 1 / 14, 14)}).select("symbol", "session", "avg_gain", "avg_loss"), 5)


_NAMES = [n for g in EXPR for n in EXPR[g]]
_ALL = {n: e for g in EXPR for n, e in EXPR[g].items()}


@query(
    "feature_complete_case",
    f"WITH {features_sql(_ALL)} SELECT symbol, count(*) AS n_complete, min(session) AS first_session, max(session) AS last_session FROM feats WHERE {' AND '.join(f'{n} IS NOT NULL' for n in _NAMES)} GROUP BY 1"
)
def feature_complete_case(spark, sf):
    registry = X.REGISTRY.without(["momentum"])
    done = X.complete_cases(X.build(snapshot(spark, sf), registry), registry.names())
    return done.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_complete"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))


@query("feature_prefix_invariance", f"WITH {SNAPSHOT} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM snap WHERE session < DATE '1998-01-01'")
def feature_prefix_invariance(spark, sf):
    # month ends need the calendar, which is known ahead; all other features see the past alone
    return X.look_ahead(snapshot(spark, sf), dt.date(1998, 1, 1), X.REGISTRY.without(["calendar"]))


@query(
    "ablation_group_exclusion",
    f"WITH {features_sql({n: e for g in ('trend', 'volatility', 'volume') for n, e in EXPR[g].items()})} SELECT symbol, count(*) AS n_complete FROM feats WHERE {' AND '.join(f'{n} IS NOT NULL' for g in ('trend', 'volatility', 'volume') for n in EXPR[g])} GROUP BY 1",
)
def ablation_group_exclusion(spark, sf):
    r = X.REGISTRY.without([g for g in X.REGISTRY.groups if g not in ("trend", "volatility", "volume")])
    return X.complete_cases(X.build(snapshot(spark, sf), r), r.names()).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_complete"))


@query(
    "rolling_quantile_regime",
    f"WITH {SNAPSHOT} SELECT symbol, session, round({full('quantile_cont({}, 0.75)', 'vix', 252, 60)}, 8) + 0.0 AS q75, round({full('quantile_cont({}, 0.25)', 'vix', 252, 60)}, 8) + 0.0 AS q25 FROM snap"
)
def rolling_quantile_regime(spark, sf):
    return rounded(
        snapshot(spark, sf).select(
            "symbol", "session", C.rolling_quantile("vix", 0.75, 252, 60).alias("q75"),
            C.rolling_quantile("vix", 0.25, 252, 60).alias("q25")
        )
    )


_RET = f"{BARS}, r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM bars)"


def returns(spark, sf):
    return market_bars(spark, sf).withColumn("ret", C.div(F.col("close"), C.lag("close")) - 1)


@query(
    "expanding_quantile",
    f"WITH {_RET}, a AS (SELECT symbol, session, abs(lag(ret) OVER ({W})) AS x FROM r) SELECT symbol, session, round(CASE WHEN count(x) OVER ({W} ROWS UNBOUNDED PRECEDING) >= 60 THEN quantile_cont(x, 0.7) OVER ({W} ROWS UNBOUNDED PRECEDING) END, 8) + 0.0 AS threshold FROM a"
)
def expanding_quantile(spark, sf):
    a = returns(spark, sf).select("symbol", "session", F.abs(C.lag("ret")).alias("x"))
    out = expanding_quantiles(a, {"threshold": ("x", 0.7, 60)})
    return rounded(out.select("symbol", "session", C.no_nan(F.col("threshold")).alias("threshold")))


@query(
    "drawdown_curve",
    f"""WITH {_RET}, e AS (SELECT symbol, session, exp(sum(ln(1 + coalesce(ret, 0) / 1000)) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS equity FROM r)
SELECT symbol, session, round(equity, 6) + 0.0 AS equity, round(equity / max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0 AS drawdown FROM e""",
)
def drawdown_curve(spark, sf):
    # returns of the stand-in prices are of the order of 1, so a thousandth of them
    w = C.series().rowsBetween(Window.unboundedPreceding, 0)
    e = returns(spark, sf).select("symbol", "session", F.product(1 + F.coalesce("ret", F.lit(0.0)) / 1000).over(w).alias("equity"))
    return rounded(e.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1), 6)


@query(
    "turnover",
    f"WITH {_RET}, s AS (SELECT symbol, session, CAST(coalesce(sign(ret), 0) AS DOUBLE) AS weight FROM r) SELECT symbol, session, weight, abs(weight - coalesce(lag(weight) OVER ({W}), 0)) AS turnover FROM s"
)
def turnover(spark, sf):
    s = returns(spark, sf).select("symbol", "session", F.coalesce(F.signum("ret"), F.lit(0.0)).alias("weight"))
    return rounded(s.withColumn("turnover", F.abs(F.col("weight") - F.coalesce(C.lag("weight"), F.lit(0.0)))))


@query("rolling_sum_momentum", f"WITH {_RET} SELECT symbol, session, round({full('sum({})', 'ret', 5)}, 8) + 0.0 AS sum_5 FROM r")
def rolling_sum_momentum(spark, sf):
    return rounded(returns(spark, sf).select("symbol", "session", C.rolling(F.sum, "ret", 5).alias("sum_5")))


@query(
    "placebo_shift",
    f"WITH {_RET} SELECT symbol, session, round(lag(ret, 5) OVER ({W}), 8) + 0.0 AS late, round(lead(ret, 5) OVER ({W}), 8) + 0.0 AS early FROM r"
)
def placebo_shift(spark, sf):
    r = returns(spark, sf).select("symbol", "session", F.col("ret").alias("late"), F.col("ret").alias("early"))
    return rounded(X.shift_block(X.shift_block(r, ["late"], 5), ["early"], -5))
