"""Positions, costs, performance, benchmarks and decomposition on the panel of segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import execution as E
from ..operators import performance as P
from .base import SNAPSHOT, query, rnd, rounded, snapshot

COST = 2.0
W = "PARTITION BY symbol ORDER BY session"

# the stand-in prices move by the order of 1 a session; a hundredth of that is like a market
FRAME = f"""{SNAPSHOT},
frame AS (
  SELECT symbol, session, open, close, vix, session_minutes, (close / open - 1) / 100 AS o2c, (close / lag(close) OVER ({W}) - 1) / 100 AS c2c,
    ln(close / open) AS r_o2c, ln(close / lag(close) OVER ({W})) AS r_c2c,
    coalesce(lag(dgs3mo) OVER ({W}) / 100 * date_diff('day', lag(session) OVER ({W}), session) / 365, 0) AS rf,
    coalesce(lag(dgs3mo) OVER ({W}) / 100 * session_minutes / (365.0 * 24 * 60), 0) AS financing
  FROM snap)"""


def frame(spark, sf, market: bool = False):
    d = snapshot(spark, sf, market)
    ret = C.div(F.col("close"), C.lag("close"))
    return d.select(
        "symbol", "session", "open", "close", "vix", "session_minutes", (
            (C.div(F.col("close"), F.col("open")) - 1) / 100
        ).alias("o2c"), ((ret - 1) / 100).alias("c2c"),
        F.log(
            C.div(F.col("close"), F.col("open"))
        ).alias("r_o2c"), F.log(ret).alias("r_c2c"), E.cash_accrual().alias("rf"), E.intraday_financing().alias("financing"),
    )


# decision rows: a forecast from the past and what comes next
DECIDE = f"""{FRAME},
m AS (SELECT *, 0.2 * coalesce(lag(o2c) OVER ({W}), 0) - 0.1 * coalesce(lag(c2c, 2) OVER ({W}), 0) AS mu,
  lead(o2c) OVER ({W}) AS next_o2c, lead(c2c) OVER ({W}) AS next_c2c, lead(financing) OVER ({W}) AS next_financing, coalesce(lead(rf) OVER ({W}), 0) AS next_rf,
  CAST(coalesce(date_diff('day', session, lead(session) OVER ({W})), 1) AS DOUBLE) AS days FROM frame),
decide AS (
  SELECT *, 2 * {COST} / 1e4 + next_financing AS band, CASE WHEN mu > 2 * {COST} / 1e4 + next_financing THEN 1.0 WHEN mu < -(2 * {COST} / 1e4 + next_financing) THEN -1.0 ELSE 0.0 END::DOUBLE AS position
  FROM m WHERE next_o2c IS NOT NULL)"""


def decide(spark, sf, market: bool = False):
    d = frame(spark, sf, market)
    mu = 0.2 * F.coalesce(C.lag("o2c"), F.lit(0.0)) - 0.1 * F.coalesce(C.lag("c2c", 2), F.lit(0.0))
    d = d.select(
        "*", mu.alias("mu"), C.lag("o2c", -1).alias("next_o2c"), C.lag("c2c", -1).alias("next_c2c"),
        C.lag("financing", -1).alias("next_financing"), F.coalesce(C.lag("rf", -1), F.lit(0.0)).alias("next_rf"),
        E.days_ahead().cast("double").alias("days")
    )
    d = d.where("next_o2c IS NOT NULL").withColumn("band", E.no_trade_band(COST, F.col("next_financing")))
    return d.withColumn("position", E.threshold_positions(F.col("mu"), F.col("band")))


@query("cash_accrual", f"WITH {FRAME} SELECT symbol, session, {rnd('rf', digits=10)} FROM frame")
def cash_accrual(spark, sf):
    return rounded(frame(spark, sf).select("symbol", "session", "rf"), 10)


@query("intraday_financing", f"WITH {FRAME} SELECT symbol, session, {rnd('financing', digits=10)} FROM frame")
def intraday_financing(spark, sf):
    return rounded(frame(spark, sf).select("symbol", "session", "financing"), 10)


@query("no_trade_band_positions", f"WITH {DECIDE} SELECT symbol, session, {rnd('mu', 'band', digits=9)}, position FROM decide")
def no_trade_band_positions(spark, sf):
    return rounded(decide(spark, sf).select("symbol", "session", "mu", "band", "position"), 9)


@query(
    "o2c_net",
    f"WITH {DECIDE} SELECT symbol, session, round(position * next_o2c - 2 * {COST} / 1e4 * abs(position) - next_financing * abs(position), 9) + 0.0 AS net FROM decide"
)
def o2c_net(spark, sf):
    d = decide(spark, sf)
    return rounded(d.select("symbol", "session", E.open_close_net(F.col("position"), F.col("next_o2c"), F.col("next_financing"), COST).alias("net")), 9)


C2C = f"""c AS (
  SELECT symbol, session, position * (next_c2c - next_rf) - {COST} / 1e4 * (abs(position - coalesce(lag(position) OVER ({W}), 0)) + CASE WHEN lead(session) OVER ({W}) IS NULL THEN abs(position) ELSE 0 END)
    - {E.BORROW_BPS} / 1e4 * (coalesce(date_diff('day', session, lead(session) OVER ({W})), 1) / 365.0) * greatest(-position, 0) AS net FROM decide)"""


@query("c2c_net", f"WITH {DECIDE}, {C2C} SELECT symbol, session, {rnd('net', digits=9)} FROM c")
def c2c_net(spark, sf):
    return rounded(E.close_close_net(decide(spark, sf), "position", "next_c2c", "next_rf", COST).select("symbol", "session", "net"), 9)


_V = "({w} * (d.mu - d.next_rf) - 0.0002 * abs({w} - p.w) - 0.003 * (d.days / 365) * {b})"


@query(
    "onestep_optimal_positions",
    f"""WITH RECURSIVE {DECIDE}, d AS (SELECT *, row_number() OVER ({W}) AS rn FROM decide),
p AS (
  SELECT symbol, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DATE) AS session, CAST(0 AS DOUBLE) AS w FROM d WHERE rn = 1
  UNION ALL
  SELECT d.symbol, d.rn, d.session, CAST(CASE WHEN {_V.format(w='-1.0', b='1')} >= {_V.format(w='0.0', b='0')} AND {_V.format(w='-1.0', b='1')} >= {_V.format(w='1.0', b='0')} THEN -1
    WHEN {_V.format(w='0.0', b='0')} >= {_V.format(w='1.0', b='0')} THEN 0 ELSE 1 END AS DOUBLE)
  FROM p JOIN d ON d.symbol = p.symbol AND d.rn = p.rn + 1)
SELECT symbol, session, w AS position FROM p WHERE rn > 0""",
)
def onestep_optimal_positions(spark, sf):
    d = decide(spark, sf).select("symbol", "session", "mu", "next_rf")
    return rounded(E.one_step_positions(d, "mu", "next_rf", COST).select("symbol", "session", "position"))


_PROBS = f"{DECIDE}, prob AS (SELECT *, exp(-400 * mu) AS es, exp(400 * mu) AS el FROM decide), probs AS (SELECT *, es / (es + 1 + el) AS p_short, 1 / (es + 1 + el) AS p_flat, el / (es + 1 + el) AS p_long FROM prob)"


def probs(spark, sf):
    d = decide(spark, sf).withColumns({"es": F.exp(-400 * F.col("mu")), "el": F.exp(400 * F.col("mu"))})
    total = F.col("es") + 1 + F.col("el")
    return d.withColumns({"p_short": F.col("es") / total, "p_flat": 1 / total, "p_long": F.col("el") / total})


@query(
    "rule_argmax",
    f"WITH {_PROBS} SELECT symbol, session, CAST(CASE WHEN p_short >= p_flat AND p_short >= p_long THEN -1 WHEN p_flat >= p_long THEN 0 ELSE 1 END AS DOUBLE) AS position FROM probs"
)
def rule_argmax(spark, sf):
    return rounded(probs(spark, sf).select("symbol", "session", E.argmax_positions(F.col("p_short"), F.col("p_flat"), F.col("p_long")).alias("position")))


@query(
    "rule_expanding_quantile",
    f"""WITH {DECIDE}, a AS (SELECT *, abs(lag(mu) OVER ({W})) AS x FROM decide),
h AS (SELECT *, CASE WHEN count(x) OVER ({W} ROWS UNBOUNDED PRECEDING) >= 60 THEN quantile_cont(x, 0.7) OVER ({W} ROWS UNBOUNDED PRECEDING) END AS q FROM a)
SELECT symbol, session, CAST(coalesce(CASE WHEN abs(mu) > q + 1e-12 THEN sign(mu) END, 0) AS DOUBLE) AS position FROM h""",
)
def rule_expanding_quantile(spark, sf):
    d = decide(spark, sf).select("symbol", "session", "mu")
    return rounded(E.expanding_quantile_positions(d, "mu", 0.7).select("symbol", "session", "position"))


@query(
    "rule_vol_target",
    f"""WITH {DECIDE}, v AS (SELECT *, CASE WHEN count(c2c) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN stddev_samp(c2c) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sd FROM decide),
l AS (SELECT *, lag(sd) OVER ({W}) * sqrt(252) AS vol FROM v)
SELECT symbol, session, round(coalesce(position * least(0.1 / nullif(vol, 0), CASE WHEN vol <> 0 THEN 1 END), 0), 8) + 0.0 AS weight FROM l""",
)
def rule_vol_target(spark, sf):
    d = decide(spark, sf).select("symbol", "session", "position", C.rolling_sd("c2c", 20).alias("sd"))
    d = d.withColumn("vol", C.lag("sd") * F.sqrt(F.lit(252.0)))
    return rounded(d.select("symbol", "session", E.vol_target_weight(F.col("position"), F.col("vol"), 0.1).alias("weight")))


_DELTAS = "(VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0))"


@query(
    "rule_delta_margin",
    f"WITH {DECIDE} SELECT symbol, delta, count(*) AS n, CAST(sum(CASE WHEN mu > (1 + delta) * band OR mu < -(1 + delta) * band THEN 1 ELSE 0 END) AS BIGINT) AS n_active FROM decide, {_DELTAS} AS t(delta) GROUP BY 1, 2"
)
def rule_delta_margin(spark, sf):
    deltas = F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 1.0))))
    d = decide(spark, sf).select("symbol", "mu", "next_financing", deltas.alias("delta"))
    w = E.threshold_positions(F.col("mu"), E.no_trade_band(COST, F.col("next_financing"), F.col("delta")))
    return rounded(d.withColumn("w", w).groupBy("symbol", "delta").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("w") != 0).alias("n_active")))


_COSTS = "(VALUES (0.0::DOUBLE), (1.0), (2.0), (5.0), (10.0))"
COSTS = (0.0, 1.0, 2.0, 5.0, 10.0)


@query(
    "rule_reoptimised_cost",
    f"""WITH {DECIDE}, c AS (SELECT *, CASE WHEN mu > 2 * cost / 1e4 + next_financing THEN 1.0 WHEN mu < -(2 * cost / 1e4 + next_financing) THEN -1.0 ELSE 0.0 END::DOUBLE AS w FROM decide, {_COSTS} AS t(cost)),
n AS (SELECT *, w * next_o2c - 2 * cost / 1e4 * abs(w) - next_financing * abs(w) AS net FROM c)
SELECT symbol, cost AS cost_bps, count(*) AS n, round(avg(net) * 252, 8) + 0.0 AS ann_mean, round(avg(abs(w)), 8) + 0.0 AS participation FROM n GROUP BY 1, 2""",
)
def rule_reoptimised_cost(spark, sf):
    d = decide(spark, sf).select("symbol", "mu", "next_o2c", "next_financing", F.explode(F.array(*map(F.lit, COSTS))).alias("cost_bps"))
    d = d.withColumn("w", E.threshold_positions(F.col("mu"), E.no_trade_band(F.col("cost_bps"), F.col("next_financing"))))
    d = d.withColumn("net", E.open_close_net(F.col("w"), F.col("next_o2c"), F.col("next_financing"), F.col("cost_bps")))
    return rounded(
        d.groupBy("symbol", "cost_bps").agg(F.count(F.lit(1)).alias("n"), (F.avg("net") * 252).alias("ann_mean"), F.avg(F.abs("w")).alias("participation"))
    )


@query(
    "trade_ledger",
    f"""WITH {DECIDE}, l AS (SELECT *, (SELECT 1) AS one FROM decide)
SELECT symbol, session, position, round(position * next_o2c, 9) + 0.0 AS gross, round(2 * {COST} / 1e4 * abs(position), 9) + 0.0 AS execution_cost, round(next_financing * abs(position), 9) + 0.0 AS financing_cost,
  round(position * next_o2c - 2 * {COST} / 1e4 * abs(position) - next_financing * abs(position), 9) + 0.0 AS net FROM l WHERE position <> 0""",
)
def trade_ledger(spark, sf):
    w, f = F.col("position"), F.col("next_financing")
    d = decide(spark, sf).where("position != 0")
    return rounded(
        d.select(
            "symbol", "session", "position", (w * F.col("next_o2c")).alias("gross"),
            (2 * COST / 1e4 * F.abs(w)).alias("execution_cost"), (f * F.abs(w)).alias("financing_cost"),
            E.open_close_net(w, F.col("next_o2c"), f, COST).alias("net")
        ),
        9
    )


# benchmark rows, one for each session and benchmark
_SUM5 = f"CASE WHEN count(r_c2c) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5 THEN sum(r_c2c) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END"
BENCH = f"""{FRAME}, s AS (SELECT *, {_SUM5} AS s5 FROM frame),
g AS (SELECT *, coalesce(sign(lag(r_o2c) OVER ({W})), 0) AS d_o2c, coalesce(sign(lag(r_c2c) OVER ({W})), 0) AS d_c2c, coalesce(sign(lag(s5) OVER ({W})), 0) AS d_m FROM s),
bench AS (SELECT g.*, benchmark, CAST(CASE benchmark WHEN 'cash' THEN 0 WHEN 'always_long' THEN 1 WHEN 'always_short' THEN -1 WHEN 'prior_open_close' THEN d_o2c WHEN 'prior_close_close' THEN d_c2c WHEN 'momentum_5' THEN d_m ELSE -d_m END AS DOUBLE) AS weight
  FROM g, (VALUES ('cash'), ('always_long'), ('always_short'), ('prior_open_close'), ('prior_close_close'), ('momentum_5'), ('reversal_5')) AS t(benchmark))"""
NET = f"net AS (SELECT *, weight * o2c - 2 * {COST} / 1e4 * abs(weight) - financing * abs(weight) AS excess FROM bench)"


def bench(spark, sf, market: bool = False):
    return P.long_weights(frame(spark, sf, market), P.open_close_weights(), ["symbol", "session", "vix", "o2c", "c2c", "rf", "financing"])


def bench_net(spark, sf, market: bool = False):
    d = bench(spark, sf, market).withColumn("excess", E.open_close_net(F.col("weight"), F.col("o2c"), F.col("financing"), COST))
    return d.withColumn("total", F.col("excess") + F.col("rf"))


@query("benchmark_weights", f"WITH {BENCH} SELECT symbol, session, benchmark, weight + 0.0 AS weight FROM bench")
def benchmark_weights(spark, sf):
    return rounded(bench(spark, sf).select("symbol", "session", "benchmark", "weight"))


PERF = f"""p AS (SELECT *, excess + rf AS total, abs(weight - lag(weight) OVER (PARTITION BY symbol, benchmark ORDER BY session)) AS turn FROM net),
e AS (SELECT *, product(1 + total) OVER (PARTITION BY symbol, benchmark ORDER BY session ROWS UNBOUNDED PRECEDING) AS equity FROM p),
dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol, benchmark ORDER BY session ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM e),
a AS (SELECT symbol, benchmark, count(*) AS sessions, round(count(*) / 252.0, 2) AS years, avg(excess) * 252 AS ann_mean_excess, avg(total) * 252 AS ann_mean_total, stddev_samp(excess) * sqrt(252) AS ann_vol_excess,
  CASE WHEN stddev_samp(excess) > 0 THEN avg(excess) / stddev_samp(excess) * sqrt(252) END AS sharpe_excess,
  CASE WHEN count(*) FILTER (excess < 0) > 1 AND stddev_samp(excess) FILTER (excess < 0) > 0 THEN avg(excess) * 252 / (stddev_samp(excess) FILTER (excess < 0) * sqrt(252)) END AS sortino_excess,
  min(drawdown) AS max_drawdown, arg_max(equity, session) AS terminal_wealth, avg(CASE WHEN weight <> 0 THEN 1.0 ELSE 0.0 END) AS participation_rate, avg(weight) AS avg_net_exposure, avg(abs(weight)) AS avg_gross_exposure,
  avg(coalesce(turn, 0)) * 252 AS turnover_per_year, avg(CASE WHEN sign(weight) = sign(o2c) THEN 1.0 ELSE 0.0 END) FILTER (weight <> 0) AS hit_rate_active FROM dd GROUP BY 1, 2),
perf AS (SELECT *, CASE WHEN terminal_wealth > 0 THEN pow(terminal_wealth, 252.0 / sessions) - 1 END AS cagr_total FROM a)"""
METRICS = (
    "ann_mean_excess", "ann_mean_total", "ann_vol_excess", "sharpe_excess", "sortino_excess", "max_drawdown",
    "participation_rate", "avg_net_exposure", "avg_gross_exposure", "turnover_per_year", "hit_rate_active", "cagr_total"
)


@query(
    "performance_metrics",
    f"WITH {BENCH}, {NET}, {PERF} SELECT symbol, benchmark, sessions, CAST(years AS DOUBLE) AS years, {rnd(*METRICS, digits=6)}, round(terminal_wealth, 3) + 0.0 AS terminal_wealth, round(CASE WHEN max_drawdown < 0 THEN cagr_total / abs(max_drawdown) END, 6) + 0.0 AS calmar FROM perf"
)
def performance_metrics(spark, sf):
    return rounded(P.performance(bench_net(spark, sf), ["symbol", "benchmark"], gross="o2c").withColumn("terminal_wealth", F.round("terminal_wealth", 3)), 6)


@query(
    "benchmark_net_performance",
    f"""WITH {BENCH}, {NET}, {PERF} SELECT symbol, benchmark, sessions, {rnd('ann_mean_excess', 'sharpe_excess', 'max_drawdown', 'participation_rate', digits=6)}, round(terminal_wealth, 3) + 0.0 AS terminal_wealth FROM perf WHERE benchmark IN ('always_long', 'prior_open_close')""",
)
def benchmark_net_performance(spark, sf):
    """The flagship: cost-adjusted performance of prior-day direction against always-long."""
    d = bench_net(spark, sf).where(F.col("benchmark").isin("always_long", "prior_open_close"))
    return rounded(
        P.performance(d, ["symbol", "benchmark"]).select(
            "symbol", "benchmark", "sessions", "ann_mean_excess", "sharpe_excess", "max_drawdown", "participation_rate",
            F.round("terminal_wealth", 3).alias("terminal_wealth")
        ),
        6
    )


@query(
    "benchmark_grid",
    f"""WITH {BENCH}, w AS (SELECT 'full' AS part, DATE '1900-01-01' AS lo UNION ALL SELECT 'late', DATE '1997-01-01'),
o AS (SELECT part, 'open_to_close' AS spec, benchmark, symbol, session, cost, weight * o2c - 2 * cost / 1e4 * abs(weight) - financing * abs(weight) AS excess, weight FROM bench, w, {_COSTS} AS t(cost) WHERE session >= lo),
k AS (SELECT part, 'close_to_close' AS spec, benchmark, symbol, session, cost, weight * (coalesce(c2c, 0) - rf) - cost / 1e4 * abs(weight - coalesce(lag(weight) OVER z, 0))
    - {E.BORROW_BPS} / 1e4 * (coalesce(date_diff('day', lag(session) OVER z, session), 1) / 365.0) * greatest(-weight, 0) AS excess, weight
  FROM bench, w, {_COSTS} AS t(cost) WHERE session >= lo AND benchmark IN ('always_long', 'prior_close_close', 'momentum_5', 'reversal_5') WINDOW z AS (PARTITION BY part, cost, benchmark, symbol ORDER BY session)),
u AS (SELECT * FROM o UNION ALL SELECT * FROM k)
SELECT part, spec, CASE WHEN spec = 'close_to_close' AND benchmark = 'always_long' THEN 'buy_and_hold' ELSE benchmark END AS benchmark, symbol, cost AS cost_bps, count(*) AS sessions, round(avg(excess) * 252, 8) + 0.0 AS ann_mean,
  round(CASE WHEN stddev_samp(excess) > 1e-15 THEN avg(excess) / stddev_samp(excess) * sqrt(252) END, 6) + 0.0 AS sharpe FROM u GROUP BY ALL""",
)
def benchmark_grid(spark, sf):
    d = frame(spark, sf)
    keep = ["symbol", "session", "o2c", "c2c", "rf", "financing"]
    parts = F.inline(
        F.array(
            F.struct(F.lit("full").alias("part"), F.lit("1900-01-01").cast("date").alias("lo")),
            F.struct(F.lit("late").alias("part"), F.lit("1997-01-01").cast("date").alias("lo"))
        )
    )
    costs = F.explode(F.array(*map(F.lit, COSTS))).alias("cost_bps")
    o = P.long_weights(d, P.open_close_weights(), keep).select("*", parts).where("session >= lo").select("*", costs)
    o = o.withColumn(
        "excess", E.open_close_net(F.col("weight"), F.col("o2c"), F.col("financing"), F.col("cost_bps"))
    ).withColumn("spec", F.lit("open_to_close"))
    k = P.long_weights(d, P.close_close_weights(), keep).select("*", parts).where("session >= lo").select("*", costs).na.fill(0.0, ["c2c"])
    k = E.close_close_same_row(
        k, "weight", "c2c", "rf", F.col("cost_bps"), name="excess", by=("part", "cost_bps", "benchmark", "symbol")
    ).withColumn("spec", F.lit("close_to_close"))
    names = ["part", "spec", "benchmark", "symbol", "cost_bps"]
    u = o.select(*names, "excess").unionByName(k.select(*names, "excess"))
    sd = F.stddev_samp("excess")
    out = u.groupBy(*names).agg(
        F.count(F.lit(1)).alias("sessions"), F.round(F.avg("excess") * 252, 8).alias("ann_mean"),
        F.round(F.when(sd > 1e-15, F.avg("excess") / F.when(sd > 1e-15, sd) * F.sqrt(F.lit(252.0))), 6).alias("sharpe")
    )
    return rounded(out)


@query(
    "breakeven",
    f"WITH {BENCH} SELECT symbol, benchmark, round((avg(weight * o2c) - avg(financing * abs(weight))) / nullif(2 * avg(abs(weight)), 0) * 1e4, 6) + 0.0 AS breakeven_bps FROM bench GROUP BY 1, 2"
)
def breakeven(spark, sf):
    return rounded(
        bench(spark, sf).groupBy("symbol", "benchmark").agg(P.breakeven_bps(F.col("weight"), F.col("o2c"), F.col("financing")).alias("breakeven_bps")),
        6
    )


@query(
    "decomposition",
    f"""WITH {DECIDE}, t AS (SELECT symbol, avg((position - 1) * next_o2c) * 252 AS a, avg(2 * {COST} / 1e4 * (1 - abs(position))) * 252 AS b, avg(next_financing * (1 - abs(position))) * 252 AS c FROM decide GROUP BY 1)
SELECT symbol, round(a, 8) + 0.0 AS ann_gross_timing, round(b, 8) + 0.0 AS ann_cost_saving, round(c, 8) + 0.0 AS ann_financing_saving, round(a + b + c, 8) + 0.0 AS ann_net_excess_vs_always_long FROM t""",
)
def decomposition(spark, sf):
    return rounded(decide(spark, sf).groupBy("symbol").agg(*P.decomposition(F.col("position"), F.col("next_o2c"), F.col("next_financing"), COST)))


@query(
    "regime_performance",
    f"""WITH {DECIDE}, n AS (SELECT *, position * next_o2c - 2 * {COST} / 1e4 * abs(position) - next_financing * abs(position) AS net FROM decide),
q AS (SELECT *, quantile_cont(vix, 1.0 / 3) OVER (PARTITION BY symbol) AS q1, quantile_cont(vix, 2.0 / 3) OVER (PARTITION BY symbol) AS q2 FROM n),
l AS (SELECT symbol, net, position, 'year' AS dimension, CAST(year(session) AS VARCHAR) AS bucket FROM q UNION ALL SELECT symbol, net, position, 'vix_tercile', CASE WHEN vix <= q1 THEN 'low' WHEN vix <= q2 THEN 'mid' WHEN vix IS NOT NULL THEN 'high' END FROM q)
SELECT symbol, dimension, bucket, count(*) AS sessions, round(avg(CASE WHEN position <> 0 THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS participation_rate, round(avg(net) * 252, 8) + 0.0 AS ann_mean,
  round(CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(252) END, 6) + 0.0 AS sharpe FROM l WHERE bucket IS NOT NULL GROUP BY 1, 2, 3""",
)
def regime_performance(spark, sf):
    d = decide(spark, sf).withColumn(
        "net", E.open_close_net(F.col("position"), F.col("next_o2c"), F.col("next_financing"), COST)
    ).withColumn("tercile", P.tercile("vix", ["symbol"]))
    out = P.regime_table(d, ["symbol"], {"year": F.year("session"), "vix_tercile": F.col("tercile")}, weight="position")
    return rounded(out.withColumn("sharpe", F.round("sharpe", 6)))


@query(
    "cost_sensitivity",
    f"WITH {DECIDE}, n AS (SELECT symbol, cost, position * next_o2c - 2 * cost / 1e4 * abs(position) - next_financing * abs(position) AS net FROM decide, {_COSTS} AS t(cost)) SELECT symbol, cost AS cost_bps, round(avg(net) * 252, 8) + 0.0 AS ann_mean, round(CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(252) END, 6) + 0.0 AS sharpe FROM n GROUP BY 1, 2"
)
def cost_sensitivity(spark, sf):
    d = decide(spark, sf).select("symbol", "position", "next_o2c", "next_financing", F.explode(F.array(*map(F.lit, COSTS))).alias("cost_bps"))
    net = E.open_close_net(F.col("position"), F.col("next_o2c"), F.col("next_financing"), F.col("cost_bps"))
    return rounded(
        d.withColumn("net", net).groupBy("symbol", "cost_bps").agg((F.avg("net") * 252).alias("ann_mean"), F.round(C.sharpe(F.col("net")), 6).alias("sharpe"))
    )


@query(
    "vol_matched",
    f"WITH {FRAME} SELECT symbol, session, round(CASE WHEN stddev_samp(c2c) OVER (PARTITION BY symbol) > 0 THEN c2c * stddev_samp(o2c) OVER (PARTITION BY symbol) / stddev_samp(c2c) OVER (PARTITION BY symbol) ELSE c2c END, 9) + 0.0 AS matched FROM frame"
)
def vol_matched(spark, sf):
    d = frame(spark, sf)
    return rounded(d.select("symbol", "session", P.vol_matched(d, "c2c", "o2c", ["symbol"]).alias("matched")), 9)


@query(
    "paired_scores",
    f"""WITH {BENCH}, {NET}, b AS (SELECT symbol, session, excess AS base FROM net WHERE benchmark = 'always_long')
SELECT symbol, benchmark, count(*) AS n_shared, round(avg(excess - base) * 252, 8) + 0.0 AS ann_difference, count(DISTINCT weight) AS n_weights FROM net JOIN b USING (symbol, session) WHERE benchmark <> 'always_long' GROUP BY 1, 2""",
)
def paired_scores(spark, sf):
    d = bench_net(spark, sf)
    base = d.where("benchmark = 'always_long'").select("symbol", "session", F.col("excess").alias("base"))
    other = d.where("benchmark != 'always_long'").select("symbol", "session", "benchmark", "excess", "weight")
    return rounded(
        other.join(base, ["symbol", "session"]).groupBy("symbol", "benchmark").agg(
            F.count(F.lit(1)).alias("n_shared"), (F.avg(F.col("excess") - F.col("base")) * 252).alias("ann_difference"),
            F.countDistinct("weight").alias("n_weights")
        )
    )


@query(
    "argmax_benchmark",
    f"WITH {BENCH}, {NET}, a AS (SELECT symbol, benchmark, avg(excess) AS m FROM net GROUP BY 1, 2) SELECT symbol, benchmark, round(m, 10) + 0.0 AS mean_excess FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(m, 12) DESC, benchmark) AS rn FROM a) WHERE rn = 1"
)
def argmax_benchmark(spark, sf):
    a = bench_net(spark, sf).groupBy("symbol", "benchmark").agg(F.avg("excess").alias("m"))
    w = Window.partitionBy("symbol").orderBy(F.desc(F.round("m", 12)), "benchmark")
    return a.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("symbol", "benchmark", (F.round("m", 10) + 0.0).alias("mean_excess"))
