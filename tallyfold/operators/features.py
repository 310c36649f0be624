"""The 81 causal features in 13 groups, as a registry of Column expressions over one window specification.

Input columns: symbol, session, open, high, low, close, volume, vix, dxy, tnx, oil, dgs2, dgs10, qqq_close,
iwm_close, dia_close. Expressions stack in levels: what a level uses, an earlier one has named, so that
each level is one projection and Catalyst keeps a single exchange and sort for all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions.smoothing import smooth

#: Lags and windows.
MACRO_LAGS, STYLE_LAGS, RETURN_LAGS = (1, 2, 3, 5, 10, 20), (1, 2, 3, 5, 10), (2, 3, 5, 10)
SMA_WINDOWS, VOL_WINDOWS, Z_WINDOWS = (5, 10, 20, 50), (5, 10, 20, 60), (20, 60)
REGIME_WINDOW, REGIME_LEAST = 252, 60


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    formula: str
    expr: Callable[[], Column]
    scale_free: bool = True
    notes: str = ""


@dataclass
class Registry:
    features: list[Feature] = field(default_factory=list)

    def add(self, name: str, group: str, formula: str, expr: Callable[[], Column], **more) -> None:
        if any(f.name == name for f in self.features):
            raise ValueError(f"feature {name} is registered twice")
        self.features.append(Feature(name, group, formula, expr, **more))

    @property
    def groups(self) -> list[str]:
        return list(dict.fromkeys(f.group for f in self.features))

    def names(self, group: str | None = None) -> list[str]:
        return [f.name for f in self.features if group in (None, f.group)]

    def without(self, excluded: list[str]) -> Registry:
        """The features of all groups but the excluded; an unknown group raises."""
        if unknown := set(excluded) - set(self.groups):
            raise ValueError(f"unknown feature groups: {sorted(unknown)}")
        return Registry([f for f in self.features if f.group not in excluded])


def _registry() -> Registry:
    r, c = Registry(), F.col
    r.add("log_ret", "lagged_return", "ln(C[t] / C[t-1])", lambda: c("_ret"))
    for k in RETURN_LAGS:
        r.add(f"ret_lag_{k}", "lagged_return", f"ln(C[t] / C[t-{k}])", lambda k=k: C.log_return("close", k))
    for w in SMA_WINDOWS:
        r.add(f"SMA_gap_{w}", "trend", f"(C - SMA{w}) / SMA{w}", lambda w=w: C.div(c("close") - C.rolling_mean("close", w), C.rolling_mean("close", w)))
    r.add(
        "RSI_14", "momentum", "100 - 100 / (1 + EWM(gain, 1/14) / EWM(loss, 1/14))",
        lambda: F.when(c("_loss14") > 0, 100 - 100 / (1 + c("_gain14") / c("_loss14"))).when((c("_loss14") == 0) & (c("_gain14") > 0), F.lit(100.0))
    )
    r.add(
        "MACD_hist", "momentum", "(EMA12 - EMA26) - EMA9(EMA12 - EMA26)", lambda: c("_macd") - c("_macd9"),
        scale_free=False, notes="a difference of price levels"
    )
    for w in VOL_WINDOWS:
        r.add(f"Volatility_{w}", "volatility", f"sd of log returns over {w}", lambda w=w: C.rolling_sd("_ret", w))
    r.add("BB_width", "bollinger", "4 sd20 / SMA20", lambda: C.div(4 * C.rolling_sd("close", 20), C.rolling_mean("close", 20)))
    r.add(
        "BB_percent_b", "bollinger", "(C - lower) / (upper - lower), bands at 2 sd20",
        lambda: C.div(c("close") - (C.rolling_mean("close", 20) - 2 * C.rolling_sd("close", 20)), 4 * C.rolling_sd("close", 20))
    )
    r.add("VIX", "macro_change", "level", lambda: c("vix"))
    for s in ("vix", "dxy", "oil"):
        for k in MACRO_LAGS:
            r.add(f"{s.upper()}_ret_{k}", "macro_change", f"ln({s}[t] / {s}[t-{k}])", lambda s=s, k=k: C.log_return(s, k))
    for k in MACRO_LAGS:
        r.add(f"TNX_change_{k}", "macro_change", f"tnx[t] - tnx[t-{k}]", lambda k=k: c("tnx") - C.lag("tnx", k))
    for s in ("vix", "dxy", "tnx", "oil"):
        for w in Z_WINDOWS:
            r.add(f"{s.upper()}_z_{w}", "macro_zscore", f"({s} - mean{w}) / sd{w}", lambda s=s, w=w: C.rolling_z(s, w))
    late = "the spread is used one session late, as it is published after the close"
    r.add("YC_2Y10Y_change_1", "yield_curve", "S[t] - S[t-1], S the spread one session late", lambda: c("_spread") - C.lag("_spread"), notes=late)
    for w in Z_WINDOWS:
        r.add(f"YC_2Y10Y_z_{w}", "yield_curve", f"(S - mean{w}) / sd{w}", lambda w=w: C.rolling_z("_spread", w), notes=late)
    r.add("intraday_ret", "intraday", "ln(C / O)", lambda: C.log(C.div(c("close"), c("open"))))
    r.add("overnight_gap", "intraday", "ln(O[t] / C[t-1])", lambda: C.log(C.div(c("open"), C.lag("close"))))
    r.add("high_low_range", "intraday", "(H - L) / C", lambda: C.div(c("high") - c("low"), c("close")))
    r.add("close_location_value", "intraday", "(C - L) / (H - L)", lambda: C.div(c("close") - c("low"), c("high") - c("low")))
    r.add("relative_volume_20", "volume", "V / mean20", lambda: C.div(c("volume").cast("double"), C.rolling_mean(c("volume").cast("double"), 20)))
    r.add("volume_z_20", "volume", "(V - mean20) / sd20", lambda: c("_vz"))
    r.add("volume_ret_interaction", "volume", "volume_z_20 * log_ret", lambda: c("_vz") * c("_ret"))
    r.add("is_monday", "calendar", "Monday", lambda: C.flag(F.weekday("session") == 0))
    r.add("is_friday", "calendar", "Friday", lambda: C.flag(F.weekday("session") == 4))
    r.add("is_month_start", "calendar", "first session of its month in the calendar", lambda: C.flag(c("session") == c("month_first")))
    r.add("is_month_end", "calendar", "last session of its month in the calendar", lambda: C.flag(c("session") == c("month_last")))
    r.add(
        "vix_regime_high", "regime", "VIX above its trailing 75% quantile",
        lambda: C.flag(c("vix") > C.rolling_quantile("vix", 0.75, REGIME_WINDOW, REGIME_LEAST)),
        notes="0 before 60 sessions"
    )
    r.add(
        "vix_regime_low", "regime", "VIX below its trailing 25% quantile",
        lambda: C.flag(c("vix") < C.rolling_quantile("vix", 0.25, REGIME_WINDOW, REGIME_LEAST)),
        notes="0 before 60 sessions"
    )
    for s in ("qqq", "iwm", "dia"):
        for k in STYLE_LAGS:
            r.add(f"{s.upper()}_ret_{k}", "cross_market", f"ln({s}[t] / {s}[t-{k}])", lambda s=s, k=k: C.log_return(f"{s}_close", k))
    return r


REGISTRY = _registry()


def month_bounds(frame: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """month_first and month_last of each row's month: of the calendar's sessions, or, without one, of the frame's own per symbol."""
    month = F.trunc("session", "MM")
    if calendar is None:
        w = Window.partitionBy("symbol", month)
        return frame.withColumns({"month_first": F.min("session").over(w), "month_last": F.max("session").over(w)})
    bounds = calendar.groupBy(month.alias("__month")).agg(F.min("session").alias("month_first"), F.max("session").alias("month_last"))
    return frame.withColumn("__month", month).join(F.broadcast(bounds), "__month", "left").drop("__month")  # twelve rows a year


def build(frame: DataFrame, registry: Registry = REGISTRY, calendar: DataFrame | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """symbol, session and the registry's features, in its order; extra columns, such as a target, come from the same windows."""
    c, wanted = F.col, set(registry.names())
    d = frame
    if wanted & set(REGISTRY.names("calendar")):
        d = month_bounds(d, calendar)
    if wanted & set(REGISTRY.names("momentum")):
        d = d.withColumn("_delta", c("close") - C.lag("close")).withColumns({"_gain": C.clip(c("_delta"), lo=0.0), "_loss": -C.clip(c("_delta"), hi=0.0)})
        d = smooth(
            d,
            {
                "_gain14": ("_gain", 1 / 14, 14), "_loss14": ("_loss", 1 / 14, 14), "_e12": ("close", 2 / 13, 1),
                "_e26": ("close", 2 / 27, 1), "_macd9": ("_e12 - _e26", 2 / 10, 1)
            }
        )
        d = d.withColumn("_macd", c("_e12") - c("_e26"))
    first = {}
    if wanted & set(REGISTRY.names("lagged_return") + REGISTRY.names("volatility") + REGISTRY.names("volume")):
        first["_ret"] = C.log_return("close")
    if wanted & set(REGISTRY.names("volume")):
        first["_vz"] = C.rolling_z(c("volume").cast("double"), 20)
    if wanted & set(REGISTRY.names("yield_curve")):
        first["_spread"] = C.lag(c("dgs10") - c("dgs2"))
    if first:
        d = d.withColumns(first)
    out = d.select("symbol", "session", *(f.expr().alias(f.name) for f in registry.features), *(x.alias(n) for n, x in (extra or {}).items()))
    if missing := wanted ^ (set(out.columns) - {"symbol", "session", *(extra or {})}):
        raise ValueError(f"registry and frame differ: {sorted(missing)}")
    return out


def open_close_target() -> Column:
    """The next session's C / O - 1."""
    return F.lead(C.div(F.col("close"), F.col("open")) - 1).over(C.series())


def close_close_target() -> Column:
    """C[t+1] / C[t] - 1."""
    return C.div(F.lead("close").over(C.series()), F.col("close")) - 1


def target_open_close(frame: DataFrame, name: str = "target") -> DataFrame:
    return frame.select("symbol", "session", open_close_target().alias(name))


def target_close_close(frame: DataFrame, name: str = "target") -> DataFrame:
    return frame.select("symbol", "session", close_close_target().alias(name))


def as_table(spark: SparkSession, registry: Registry = REGISTRY) -> DataFrame:
    """The registry as rows, in order."""
    return spark.createDataFrame(
        [(i, f.name, f.group, f.formula, int(f.scale_free), f.notes) for i, f in enumerate(registry.features)],
        "position int, name string, feature_group string, formula string, scale_free int, notes string"
    )


def look_ahead(frame: DataFrame, cut, registry: Registry = REGISTRY, calendar: DataFrame | None = None) -> DataFrame:
    """n_rows, n_different: features of the sessions before `cut` built from all rows and from those rows alone."""
    before = F.col("session") < F.lit(cut)
    whole, prefix = build(frame, registry, calendar).where(before), build(frame.where(before), registry, calendar)
    return whole.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(whole.exceptAll(prefix).agg(F.count(F.lit(1)).alias("n_different")))  # one row each


def complete_cases(features: DataFrame, names: list[str]) -> DataFrame:
    """The rows without a missing feature; one predicate, as the optimiser would carry a condition for each column through all that follows."""
    return features.where(F.forall(F.array(*(F.col(f"`{n}`").isNotNull() for n in names)), lambda here: here))


def shift_block(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Columns k sessions late (k > 0) or early (k < 0), for placebo and leakage tests; 0 leaves them."""
    return df.select(*(C.lag(c, k).alias(c) if c in columns and k else F.col(c) for c in df.columns))
