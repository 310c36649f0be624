"""Positions, costs and net returns under two execution specifications.

Two conventions of alignment are kept apart by name: `same_row` series belong to the session of their row
(benchmark weights are lagged and applied to the row's own return), `decision_row` series carry the next
session's return and carry on the row of the decision.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions.scan import scan
from ..functions.quantiles import expanding_quantiles

BORROW_BPS = 30.0


def cash_accrual(rate: str = "dgs3mo") -> Column:
    """Simple interest at the rate known the session before, over the calendar days since then; 0 on a first row."""
    days = F.datediff("session", C.lag("session"))
    return F.coalesce(C.lag(rate) / 100.0 * days / 365.0, F.lit(0.0))


def intraday_financing(rate: str = "dgs3mo", minutes: str = "session_minutes") -> Column:
    """Interest forgone while a session is open, at the rate known the session before; 0 on a first row."""
    return F.coalesce(C.lag(rate) / 100.0 * F.col(minutes) / (365.0 * 24.0 * 60.0), F.lit(0.0))


def days_back() -> Column:
    return F.datediff("session", C.lag("session"))


def days_ahead() -> Column:
    """Calendar days to the next session; 1 on a last row."""
    return F.coalesce(F.datediff(C.lag("session", -1), "session"), F.lit(1))


def no_trade_band(cost_bps: Column | float, financing: Column, delta: Column | float = 0.0) -> Column:
    """(1 + delta)(2c + f): what an expected return must exceed for a round trip."""
    c = (F.lit(cost_bps) if not isinstance(cost_bps, Column) else cost_bps) / 1e4
    return (1.0 + (F.lit(delta) if not isinstance(delta, Column) else delta)) * (2.0 * c + financing)


def threshold_positions(mu: Column, band: Column) -> Column:
    """1 above the band, -1 below its negative, else 0; the band is not negative."""
    return F.when(mu > band, 1.0).when(mu < -band, -1.0).otherwise(0.0)


def open_close_net(w: Column, r: Column, financing: Column, cost_bps: Column | float) -> Column:
    """w r - 2c|w| - f|w|: a round trip on every active session."""
    c = (F.lit(cost_bps) if not isinstance(cost_bps, Column) else cost_bps) / 1e4
    return w * r - 2.0 * c * F.abs(w) - financing * F.abs(w)


def close_close_net(df: DataFrame, w: str, r: str, carry: str, cost_bps: float, borrow_bps: float = BORROW_BPS, name: str = "net") -> DataFrame:
    """Decision-row net: w (r - carry) - c turnover - borrow over the days ahead; opening and closing are charged."""
    win, c = C.series(), cost_bps / 1e4
    x = F.col(w)
    last = F.lead("session").over(win).isNull()
    turnover = F.abs(x - F.coalesce(F.lag(x).over(win), F.lit(0.0))) + F.when(last, F.abs(x)).otherwise(0.0)
    borrow = borrow_bps / 1e4 * (days_ahead() / 365.0) * F.greatest(-x, F.lit(0.0))
    return df.withColumn(name, x * (F.col(r) - F.col(carry)) - c * turnover - borrow)


def close_close_same_row(
    df: DataFrame, w: str, r: str, rf: str, cost_bps: Column | float, borrow_bps: float = BORROW_BPS, name: str = "net",
    by: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """Same-row net of the benchmarks: days back, and no charge for closing the last position."""
    win = Window.partitionBy(*by).orderBy("session")
    c = (F.lit(cost_bps) if not isinstance(cost_bps, Column) else cost_bps) / 1e4
    x = F.col(w)
    held = F.coalesce(F.datediff("session", F.lag("session").over(win)), F.lit(1))
    borrow = borrow_bps / 1e4 * (held / 365.0) * F.greatest(-x, F.lit(0.0))
    return df.withColumn(name, x * (F.col(r) - F.col(rf)) - c * F.abs(x - F.coalesce(F.lag(x).over(win), F.lit(0.0))) - borrow)


def best_next(edge: Column, days: Column, cost: float, borrow: float, previous: int) -> Column:
    """The next position -1, 0 or 1 of highest value after `previous`; of equal values the smallest. -1 where the edge is missing."""
    value = {w: w * edge - cost * abs(w - previous) - borrow * (days / 365.0) * max(-w, 0) for w in (-1, 0, 1)}
    short = (value[-1] >= value[0]) & (value[-1] >= value[1])
    return F.when(edge.isNull() | F.isnan(edge) | short, -1).when(value[0] >= value[1], 0).otherwise(1)


def one_step_positions(
    df: DataFrame, mu: str, carry: str, cost_bps: float, borrow_bps: float = BORROW_BPS, delta: float = 0.0,
    name: str = "position"
) -> DataFrame:
    """Path-dependent positions: each maximises w (mu - carry) - c|w - previous| - borrow, from a flat start.

    A row maps the previous position to the next (short, flat, long: what follows each); maps compose, so the positions
    are a scan along the series. A margin (delta) is not allowed.
    """
    if delta:
        raise ValueError("this rule takes no safety margin")
    edge, days = F.col(mu) - F.col(carry), days_ahead().cast("double")
    after = [best_next(edge, F.col("__days"), cost_bps / 1e4, borrow_bps / 1e4, p).alias(k) for p, k in ((-1, "short"), (0, "flat"), (1, "long"))]
    rows = df.withColumns({"__days": days, "__at": F.row_number().over(C.series()).cast("bigint") - 1}).withColumn("m", F.struct(*after)).drop("__days")
    pick = lambda m, s: f"CASE {s} WHEN -1 THEN {m}.short WHEN 0 THEN {m}.flat ELSE {m}.long END"
    compose = lambda f, g: "struct(" + ", ".join(f"{pick(g, f'{f}.{k}')} AS {k}" for k in ("short", "flat", "long")) + ")"
    return scan(rows, ["symbol"], "__at", "0", compose, pick, name).drop("__at").withColumn(name, F.col(name).cast("double"))


def argmax_positions(p_short: Column, p_flat: Column, p_long: Column) -> Column:
    """The class of the highest probability; of equal ones the first of -1, 0, 1."""
    return F.when((p_short >= p_flat) & (p_short >= p_long), -1.0).when(p_flat >= p_long, 0.0).otherwise(1.0)


def expanding_quantile_positions(df: DataFrame, mu: str, q: float, least: int = 60, name: str = "position") -> DataFrame:
    """Positions where |mu| exceeds the q-quantile of all earlier |mu|; 0 while that is not defined.

    The interpolated quantile is compared with a margin for its last digits.
    """
    late = df.withColumn("__late", F.abs(C.lag(mu)))
    high = expanding_quantiles(late, {"__high": ("__late", q, least)})
    active = F.when(F.abs(F.col(mu)) > C.no_nan(F.col("__high")) + 1e-12, F.signum(mu))
    return high.withColumn(name, F.coalesce(active, F.lit(0.0))).drop("__late", "__high")


def vol_target_weight(position: Column, vol: Column, target: float, cap: float = 1.0) -> Column:
    """The position scaled to a target annual volatility, at most cap; vol is known a session before."""
    return F.coalesce(position * C.clip(C.div(F.lit(target), vol), hi=cap), F.lit(0.0))


@dataclass(frozen=True)
class OpenToClose:
    name: str = "open_to_close"
    extra_feature_lag: int = 0

    def target(self, frame: DataFrame) -> Column:
        return C.lag(C.div(F.col("close"), F.col("open")) - 1, -1)

    def carry(self) -> Column:
        return C.lag("financing", -1)

    def positions(self, df: DataFrame, mu: str, carry: str, cost_bps: float, delta: float = 0.0) -> DataFrame:
        return df.withColumn("position", threshold_positions(F.col(mu), no_trade_band(cost_bps, F.col(carry), delta)))

    def net(self, df: DataFrame, w: str, r: str, carry: str, cost_bps: float) -> DataFrame:
        return df.withColumn("net", open_close_net(F.col(w), F.col(r), F.col(carry), cost_bps))


@dataclass(frozen=True)
class CloseToClose:
    name: str = "close_to_close"
    extra_feature_lag: int = 1
    borrow_bps: float = BORROW_BPS

    def target(self, frame: DataFrame) -> Column:
        return C.div(C.lag("close", -1), F.col("close")) - 1

    def carry(self) -> Column:
        return F.coalesce(C.lag("rf", -1), F.lit(0.0))

    def positions(self, df: DataFrame, mu: str, carry: str, cost_bps: float, delta: float = 0.0) -> DataFrame:
        return one_step_positions(df, mu, carry, cost_bps, self.borrow_bps, delta)

    def net(self, df: DataFrame, w: str, r: str, carry: str, cost_bps: float) -> DataFrame:
        return close_close_net(df, w, r, carry, cost_bps, self.borrow_bps)


SPECS = {s.name: s for s in (OpenToClose, CloseToClose)}


def get_spec(name: str, **params):
    """A fresh specification; an unknown name or parameter raises."""
    if name not in SPECS:
        raise ValueError(f"unknown execution specification {name!r}; known: {sorted(SPECS)}")
    if unknown := set(params) - {f.name for f in fields(SPECS[name])}:
        raise ValueError(f"unknown parameters of {name}: {sorted(unknown)}")
    return SPECS[name](**params)
