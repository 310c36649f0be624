"""Labels, screening, inference, calibration, text and audit queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import audit as A
from ..operators import calibration as K
from ..operators import execution as E
from ..operators import features as X
from ..operators import inference as I
from ..operators import labels as L
from ..operators import screening as S
from ..operators import text as T
from ..operators.bars import to_bars
from ..sources import files
from .base import BARS, MARKET, SNAPSHOT, market_bars, once, query, rnd, rounded, snapshot, table
from .execution_queries import _PROBS, BENCH, FRAME, NET, W, bench_net, frame, probs
from .feature_queries import BASE, EWM_STEPS, EXPR, features_sql

INIT, STEP = 200, 21

# ---------------------------------------------------------------- labels

ZROWS = f"""{features_sql({'Volatility_20': EXPR['volatility']['Volatility_20']})},
tgt AS (SELECT symbol, session, lead(close / open - 1) OVER ({W}) AS target FROM snap),
zrows AS (SELECT f.symbol, f.session, target, ln(1 + target) / (Volatility_20 + 1e-8) AS z FROM feats f JOIN tgt USING (symbol, session) WHERE target > -1 AND Volatility_20 IS NOT NULL),
zpos AS (SELECT *, row_number() OVER ({W}) - 1 AS pos FROM zrows)"""


def zrows(spark, sf):
    s = snapshot(spark, sf)
    f = X.build(s, X.Registry([x for x in X.REGISTRY.features if x.name == "Volatility_20"]), extra={"target": X.open_close_target()})
    d = f.withColumn("z", L.vol_adjusted(F.col("target"), F.col("Volatility_20"))).where("target > -1 AND z IS NOT NULL")
    return L.positions_in_order(d.select("symbol", "session", "target", "z"))


@query(
    "vol_adjusted_labels",
    f"WITH {ZROWS}, q AS (SELECT symbol, quantile_cont(z, 0.25) AS q_lo, quantile_cont(z, 0.75) AS q_hi FROM zpos WHERE pos < {INIT} GROUP BY 1) SELECT symbol, session, round(z, 6) + 0.0 AS z, CASE WHEN z >= q_hi THEN 1 WHEN z <= q_lo THEN -1 ELSE 0 END AS label FROM zpos JOIN q USING (symbol)"
)
def vol_adjusted_labels(spark, sf):
    d = zrows(spark, sf)
    q = d.where(F.col("pos") < INIT).groupBy("symbol").agg(*L.thresholds())
    return d.join(q, "symbol").select("symbol", "session", (F.round("z", 6) + 0.0).alias("z"), L.label(F.col("z"), F.col("q_lo"), F.col("q_hi")).alias("label"))


STEPS = f"""steps AS (SELECT symbol, CAST(unnest(range(0, (max(pos) - {INIT}) // {STEP} + 1)) AS INTEGER) AS step FROM zpos GROUP BY symbol HAVING max(pos) >= {INIT}),
thr AS (SELECT s.symbol, s.step, quantile_cont(z, 0.25) AS q_lo, quantile_cont(z, 0.75) AS q_hi, count(*) AS n_train FROM steps s JOIN zpos p ON p.symbol = s.symbol AND p.pos < {INIT} + {STEP} * s.step GROUP BY 1, 2)"""


@query("walkforward_thresholds", f"WITH {ZROWS}, {STEPS} SELECT symbol, step, {rnd('q_lo', 'q_hi', digits=6)}, n_train FROM thr")
def walkforward_thresholds(spark, sf):
    return rounded(L.step_thresholds(zrows(spark, sf), INIT, STEP).select("symbol", "step", "q_lo", "q_hi", "n_train"), 6)


@query(
    "walkforward_base_rates",
    f"WITH {ZROWS}, {STEPS}, l AS (SELECT p.symbol, CASE WHEN z >= q_hi THEN 1 WHEN z <= q_lo THEN -1 ELSE 0 END AS label FROM zpos p JOIN thr t ON t.symbol = p.symbol AND t.step = (p.pos - {INIT}) // {STEP} WHERE p.pos >= {INIT}) SELECT symbol, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 8) AS share FROM l GROUP BY 1, 2"
)
def walkforward_base_rates(spark, sf):
    d = zrows(spark, sf)
    t = L.step_thresholds(d, INIT, STEP)
    rows = d.where(F.col("pos") >= INIT).withColumn("step", F.floor((F.col("pos") - INIT) / STEP).cast("int")).join(t, ["symbol", "step"])
    counts = rows.groupBy("symbol", L.label(F.col("z"), F.col("q_lo"), F.col("q_hi")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))))


@query(
    "class_conditional_means",
    f"WITH {ZROWS}, q AS (SELECT symbol, quantile_cont(z, 0.25) AS q_lo, quantile_cont(z, 0.75) AS q_hi FROM zpos GROUP BY 1), l AS (SELECT symbol, target, CASE WHEN z >= q_hi THEN 1 WHEN z <= q_lo THEN -1 ELSE 0 END AS label FROM zpos JOIN q USING (symbol)) SELECT symbol, {', '.join(f'round(coalesce(avg(target) FILTER (label = {k}), 0), 6) + 0.0 AS {n}' for k, n in ((-1, 'mean_short'), (0, 'mean_flat'), (1, 'mean_long')))} FROM l GROUP BY 1"
)
def class_conditional_means(spark, sf):
    d = zrows(spark, sf)
    q = d.groupBy("symbol").agg(*L.thresholds())
    return rounded(
        d.join(q, "symbol").withColumn("label", L.label(F.col("z"), F.col("q_lo"), F.col("q_hi"))).groupBy("symbol").agg(*L.class_means("target", "label")),
        6
    )


@query("expected_return", f"WITH {_PROBS} SELECT symbol, session, round(p_short * -0.01 + p_flat * 0.001 + p_long * 0.012, 9) + 0.0 AS mu_hat FROM probs")
def expected_return(spark, sf):
    p = probs(spark, sf).withColumns({"m_short": F.lit(-0.01), "m_flat": F.lit(0.001), "m_long": F.lit(0.012)})
    return rounded(p.select("symbol", "session", L.expected_return(K.P, ("m_short", "m_flat", "m_long")).alias("mu_hat")), 9)


@query(
    "fold_geometry",
    f"WITH {BARS}, n AS (SELECT count(*) AS n FROM bars), f AS (SELECT unnest(range(0, 5)) AS fold) SELECT CAST(fold AS INTEGER) AS fold, CAST(0 AS BIGINT) AS train_lo, n - 500 + 100 * fold - 1 AS train_hi, n - 500 + 100 * fold AS test_lo, n - 400 + 100 * fold AS test_hi FROM f, n"
)
def fold_geometry(spark, sf):
    n = market_bars(spark, sf).count()
    rows = [(i, *f) for i, f in enumerate(L.time_series_split(n, 5, 100, gap=1))] if n > 501 else []
    return spark.createDataFrame(rows, "fold int, train_lo bigint, train_hi bigint, test_lo bigint, test_hi bigint")


@query(
    "outer_schedule",
    f"WITH {BARS}, n AS (SELECT count(*) AS n FROM bars), s AS (SELECT unnest(range(0, greatest(0, CAST(ceil((n - 1000) / 21.0) AS BIGINT)))) AS step, n FROM n) SELECT CAST(step AS INTEGER) AS step, CAST(0 AS BIGINT) AS train_lo, 1000 + 21 * step AS train_hi, 1000 + 21 * step AS test_lo, least(1021 + 21 * step, n) AS test_hi, CAST(CASE WHEN step % 12 = 0 THEN 1 ELSE 0 END AS INTEGER) AS retune FROM s"
)
def outer_schedule(spark, sf):
    rows = [tuple(s.values()) for s in L.outer_steps(market_bars(spark, sf).count(), 1000, 21, 12)]
    return spark.createDataFrame(rows, "step int, train_lo bigint, train_hi bigint, test_lo bigint, test_hi bigint, retune int")


# ---------------------------------------------------------------- screening

NAMES = X.REGISTRY.names()
_GROUP = {f.name: f.group for f in X.REGISTRY.features}
#: Digits that both engines agree on; the average of price levels has fewer.
_DIGITS = {n: 3 if n == "MACD_hist" else 7 for n in NAMES}
_PLAIN = {n: e for g in EXPR for n, e in EXPR[g].items()}
SLICE = f"""RECURSIVE {features_sql(_PLAIN, BASE.replace(SNAPSHOT, MARKET))}{EWM_STEPS},
mom AS (SELECT symbol, session, CASE WHEN rn < 15 THEN NULL WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0 END AS RSI_14, e12 - e26 - m9 AS MACD_hist FROM e),
tgt AS (SELECT symbol, session, lead(close / open - 1) OVER ({W}) AS target FROM snap),
slice0 AS (SELECT f.*, RSI_14, MACD_hist, ln(1 + target) / (Volatility_20 + 1e-8) AS z FROM feats f JOIN mom USING (symbol, session) JOIN tgt USING (symbol, session) WHERE target > -1 AND {' AND '.join(f'{n} IS NOT NULL' for n in NAMES)}),
slice AS MATERIALIZED (SELECT symbol, session, round(z, 9) AS z, {', '.join(f'round(CAST({n} AS DOUBLE), {k}) AS {n}' for n, k in _DIGITS.items())}, row_number() OVER ({W}) - 1 AS pos FROM slice0)"""


def complete_rows(spark, sf, market: bool = False):
    """symbol, session, pos, target, carry, z and all features of the rows that have them all: of each segment, or of the market as a whole.

    All of it comes from one chain of windows. A join after so many named expressions would have the optimiser carry
    their equalities through; whoever joins these rows writes or persists them first.
    """
    s = snapshot(spark, sf, market).withColumn("financing", E.intraday_financing())
    f = X.build(s, extra={"target": X.open_close_target(), "carry": F.coalesce(C.lag("financing", -1), F.lit(0.0))})
    d = f.withColumn("z", L.vol_adjusted(F.col("target"), F.col("Volatility_20"))).where("target > -1 AND z IS NOT NULL")
    return L.positions_in_order(X.complete_cases(d, NAMES))


def slice_of(spark, sf):
    """All complete rows of the market, rounded as in the SQL."""
    d = complete_rows(spark, sf, True)
    return once(d.select("symbol", "session", "pos", F.round("z", 9).alias("z"), *(F.round(F.col(n).cast("double"), k).alias(n) for n, k in _DIGITS.items())))


_LONG = f"lng AS MATERIALIZED (SELECT symbol, pos, z, unnest([{', '.join(repr(n) for n in NAMES)}]) AS feature, unnest([{', '.join(NAMES)}]) AS x FROM slice)"
_SPEARMAN = f"""WITH {SLICE}, {_LONG},
win AS (SELECT e.symbol, e.feature, e.pos AS end_pos, w.x, w.z FROM lng e JOIN lng w ON w.symbol = e.symbol AND w.feature = e.feature AND w.pos BETWEEN e.pos - 59 AND e.pos WHERE e.pos >= 59),
rk AS (SELECT symbol, feature, end_pos, rank() OVER (PARTITION BY symbol, feature, end_pos ORDER BY x) + (count(*) OVER (PARTITION BY symbol, feature, end_pos, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY symbol, feature, end_pos ORDER BY z) + (count(*) OVER (PARTITION BY symbol, feature, end_pos, z) - 1) / 2.0 AS rz FROM win),
rho AS (SELECT symbol, feature, end_pos AS pos, CASE WHEN min(rx) < max(rx) AND min(rz) < max(rz) THEN corr(rx, rz) END AS rho FROM rk GROUP BY 1, 2, 3)"""


def spearman(spark, sf):
    return S.rolling_spearman_all(slice_of(spark, sf), NAMES)


@query("rolling_spearman", f"{_SPEARMAN} SELECT symbol, feature, pos, round(rho, 8) + 0.0 AS rho FROM rho")
def rolling_spearman(spark, sf):
    return rounded(spearman(spark, sf))


_IC = f"{_SPEARMAN}, ic AS (SELECT symbol, feature, coalesce(abs(avg(rho)), 0) AS ic FROM rho GROUP BY 1, 2)"


@query("information_coefficients", f"{_IC} SELECT symbol, feature, round(ic, 8) + 0.0 AS ic FROM ic")
def information_coefficients(spark, sf):
    return rounded(S.information_coefficients(spearman(spark, sf)))


_META = "meta AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{_GROUP[f]}', {i})" for i, f in enumerate(NAMES)) + ") AS t(feature, feature_group, position))"


_NAME = "split_part(r, '|', 2)"
_LINES = ", ".join("'" + "|".join((str(i), f.name, f.group)) + "'" for i, f in enumerate(X.REGISTRY.features))
_HELD = f"WITH {SLICE}, {_LONG}, held AS (SELECT symbol, feature, count(*) AS n_rows, CAST(min(x) < max(x) AS INTEGER) AS varies FROM lng GROUP BY 1, 2)"


def long_slice(spark, sf):
    """symbol, feature, x of all complete rows of the market."""
    cells = F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in NAMES)))
    return slice_of(spark, sf).select("symbol", cells)


@query(
    "feature_registry",
    # positions, names and groups as they are registered; the formulas of a few families spelled out again
    f"""{_HELD} SELECT CAST(split_part(r, '|', 1) AS INTEGER) AS position, {_NAME} AS name, split_part(r, '|', 3) AS feature_group, CAST({_NAME} <> 'MACD_hist' AS INTEGER) AS scale_free,
  CASE WHEN {_NAME} LIKE 'ret_lag_%' THEN 'ln(C[t] / C[t-' || split_part({_NAME}, '_', 3) || '])' WHEN {_NAME} LIKE 'Volatility_%' THEN 'sd of log returns over ' || split_part({_NAME}, '_', 2)
    WHEN {_NAME} LIKE 'TNX_change_%' THEN 'tnx[t] - tnx[t-' || split_part({_NAME}, '_', 3) || ']' ELSE '' END AS family_formula,
  coalesce(n_rows, 0) AS n_rows, coalesce(varies, 0) AS varies FROM (SELECT unnest([{_LINES}]) AS r) LEFT JOIN held ON feature = {_NAME}""",
)
def feature_registry(spark, sf):
    """The registry beside what the market's complete rows hold of each feature; one that does not vary is of no use to a screen."""
    family = F.col("name").rlike("^(ret_lag|Volatility|TNX_change)_")
    known = X.as_table(spark).select("position", "name", "feature_group", "scale_free", F.when(family, F.col("formula")).otherwise("").alias("family_formula"))
    x = long_slice(spark, sf)
    held = x.groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows")).join(S.varying(x).select("feature", F.lit(1).alias("varies")), "feature", "left")
    return known.join(held.withColumnRenamed("feature", "name"), "name", "left").na.fill(0, ["n_rows", "varies"])


@query(
    "feature_group_counts",
    f"{_HELD}, {_META} SELECT symbol, feature_group, count(*) AS n_features, CAST(sum(varies) AS BIGINT) AS n_varying FROM held JOIN meta USING (feature) GROUP BY 1, 2"
)
def feature_group_counts(spark, sf):
    """Features of each group, and those left when the ones without variance are dropped."""
    x = long_slice(spark, sf)
    left = S.varying(x).withColumn("varies", F.lit(1))
    groups = X.as_table(spark).select(F.col("name").alias("feature"), "feature_group")
    return x.select("symbol", "feature").distinct().join(left, ["symbol", "feature"], "left").join(groups, "feature").groupBy("symbol", "feature_group").agg(
        F.count(F.lit(1)).alias("n_features"), F.count("varies").alias("n_varying")
    )


@query(
    "topk_per_group",
    f"{_IC}, {_META}, r AS (SELECT symbol, feature, feature_group, ic, row_number() OVER (PARTITION BY symbol, feature_group ORDER BY round(ic, 9) DESC, position) AS rank_in_group FROM ic JOIN meta USING (feature)) SELECT symbol, feature, feature_group, round(round(ic, 9), 8) + 0.0 AS ic, CAST(rank_in_group AS INTEGER) AS rank_in_group FROM r WHERE rank_in_group <= {S.PER_GROUP}"
)
def topk_per_group(spark, sf):
    ics = S.information_coefficients(spearman(spark, sf)).withColumn("ic", F.round("ic", 9))
    return rounded(S.top_per_group(ics, _GROUP).select("symbol", "feature", "feature_group", "ic", "rank_in_group"))


@query(
    "correlation_pairs",
    f"WITH {SLICE}, {_META}, {_LONG}, n AS (SELECT l.*, position, min(x) OVER f < max(x) OVER f AS varies FROM lng l JOIN meta USING (feature) WINDOW f AS (PARTITION BY symbol, feature))"
    " SELECT symbol, a.feature AS a, b.feature AS b, round(CASE WHEN bool_and(a.varies AND b.varies) THEN corr(a.x, b.x) END, 7) + 0.0 AS corr FROM n a JOIN n b USING (symbol, pos) WHERE a.position < b.position GROUP BY 1, 2, 3",
)
def correlation_pairs(spark, sf):
    return rounded(S.correlation_pairs(slice_of(spark, sf), NAMES), 7)


@query("screened_features")
def screened_features(spark, sf):
    return S.screen(once(complete_rows(spark, sf)), NAMES, _GROUP)


# ---------------------------------------------------------------- inference

REPS, SEED = I.REPLICATES, I.SEED
_H = "(('0x' || substr(md5('{seed}:{tag}:' || rep || ':' || i), 1, 8))::BIGINT)"
SERIES = f"""{BENCH.replace(SNAPSHOT, MARKET)}, {NET}, idx AS (SELECT row_number() OVER (ORDER BY a.session) - 1 AS idx, a.excess AS x, b.excess AS y, a.o2c AS r FROM net a JOIN net b USING (symbol, session) WHERE a.benchmark = 'prior_open_close' AND b.benchmark = 'always_long'),
bn AS (SELECT count(*) AS n FROM idx),
bg AS (SELECT rep, i, n FROM bn, (SELECT unnest(range(0, {REPS})) AS rep), (SELECT unnest(range(0, (SELECT n FROM bn))) AS i)),
bh AS (SELECT rep, i, n, restart, CASE WHEN restart THEN {_H.format(seed=SEED, tag='s')} % n END AS start FROM (SELECT *, i = 0 OR {_H.format(seed=SEED, tag='r')} / 4294967296.0 < 1 / 20.0 AS restart FROM bg)),
bp AS (SELECT rep, i, n, last_value(CASE WHEN restart THEN start END IGNORE NULLS) OVER z AS s0, last_value(CASE WHEN restart THEN i END IGNORE NULLS) OVER z AS i0 FROM bh WINDOW z AS (PARTITION BY rep ORDER BY i ROWS UNBOUNDED PRECEDING)),
path AS (SELECT rep, i, (s0 + i - i0) % n AS idx FROM bp)"""


def paired_series(spark, sf):
    """idx, x (prior-day direction), y (always-long), r of the market as a whole; one series has as many rows as sessions."""
    return I.indexed(pairs(spark, sf, True).drop("symbol"))


def pairs(spark, sf, market: bool = False):
    """symbol, session, x, y, r of all symbols, or of the market."""
    d = bench_net(spark, sf, market).where("benchmark IN ('prior_open_close', 'always_long')")
    return d.groupBy("symbol", "session").agg(
        F.max(F.when(F.col("benchmark") == "prior_open_close", F.col("excess"))).alias("x"),
        F.max(F.when(F.col("benchmark") == "always_long", F.col("excess"))).alias("y"), F.max("o2c").alias("r")
    )


_SR = "(CASE WHEN stddev_samp({0}) > 0 THEN avg({0}) / stddev_samp({0}) * sqrt(252) END)"
_CI = "round(point, 6) + 0.0 AS point, round(quantile_cont(s, 0.025), 6) + 0.0 AS lo, round(quantile_cont(s, 0.975), 6) + 0.0 AS hi, round(stddev_samp(s), 6) + 0.0 AS se, round(avg(CASE WHEN s <= 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS fraction_nonpositive"


def _boot(spark, sf, sums, statistic, point):
    d = once(paired_series(spark, sf))
    drawn = I.draws(d, d.count(), sums, {"s": statistic}, REPS, seed=SEED)
    return rounded(I.interval(drawn, "s", d.agg(point.alias("point"))), 6)


def _boot_sql(stat: str) -> str:
    return f"WITH {SERIES}, d AS (SELECT rep, {stat} AS s FROM path JOIN idx USING (idx) GROUP BY 1), q AS (SELECT {stat} AS point FROM idx) SELECT {_CI} FROM d, q GROUP BY point"


@query("bootstrap_sharpe_ci", _boot_sql(_SR.format("x")))
def bootstrap_sharpe_ci(spark, sf):
    return _boot(spark, sf, I.moments("x"), I.moment_sharpe("x"), C.sharpe(F.col("x")))


@query("bootstrap_paired_diff", _boot_sql(f"{_SR.format('x')} - {_SR.format('y')}"))
def bootstrap_paired_diff(spark, sf):
    return _boot(spark, sf, I.moments("x", "y"), I.moment_sharpe("x") - I.moment_sharpe("y"), C.sharpe(F.col("x")) - C.sharpe(F.col("y")))


@query("bootstrap_slope", _boot_sql("regr_slope(x, r)"))
def bootstrap_slope(spark, sf):
    return _boot(spark, sf, I.moments("x", "r"), I.moment_slope("x", "r"), I.slope("x", "r"))


@query(
    "ols_slope",
    f"WITH {BENCH}, {NET} SELECT symbol, benchmark, round(CASE WHEN var_samp(o2c) > 0 THEN covar_samp(excess, o2c) / var_samp(o2c) END, 8) + 0.0 AS slope FROM net GROUP BY 1, 2"
)
def ols_slope(spark, sf):
    return rounded(bench_net(spark, sf).groupBy("symbol", "benchmark").agg(I.slope("excess", "o2c").alias("slope")))


@query(
    "jobson_korkie_z",
    f"""WITH {SERIES}, a AS (SELECT avg(x) / stddev_samp(x) AS sa, avg(y) / stddev_samp(y) AS sb, corr(x, y) AS rho, count(*) AS n FROM idx)
SELECT round(rho, 8) + 0.0 AS rho, round((sa - sb) / sqrt((2 - 2 * rho + 0.5 * (sa * sa + sb * sb - 2 * sa * sb * rho * rho)) / n), 6) + 0.0 AS z FROM a""",
)
def jobson_korkie_z(spark, sf):
    out = paired_series(spark, sf).agg(*I.jobson_korkie("x", "y"))
    return out.select((F.round("rho", 8) + 0.0).alias("rho"), (F.round("z", 6) + 0.0).alias("z"))


#: Two-sided normal p-value of z: twice the integral of the density from |z| to |z| + 12, by Simpson's rule.
_P = "round(2 * 0.003 / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(abs(z) + i * 0.003, 2) / 2))), 6) + 0.0"


@query(
    "jobson_korkie_p",
    f"""WITH {BENCH}, {NET}, jp AS (SELECT symbol, a.excess AS x, b.excess AS y FROM net a JOIN net b USING (symbol, session) WHERE a.benchmark = 'prior_open_close' AND b.benchmark = 'always_long'),
js AS (SELECT symbol, avg(x) / stddev_samp(x) AS sa, avg(y) / stddev_samp(y) AS sb, corr(x, y) AS rho, count(*) AS n FROM jp GROUP BY 1),
jz AS (SELECT symbol, (sa - sb) / sqrt((2 - 2 * rho + 0.5 * (sa * sa + sb * sb - 2 * sa * sb * rho * rho)) / n) AS z FROM js)
SELECT symbol, round(z, 6) + 0.0 AS z, {_P} AS p_value FROM jz""",
)
def jobson_korkie_p(spark, sf):
    return pairs(spark, sf).groupBy("symbol").agg(*I.jobson_korkie("x", "y")).select(
        "symbol", (F.round("z", 6) + 0.0).alias("z"), (F.round(I.two_sided_p("z"), 6) + 0.0).alias("p_value")
    )


# the normal quantile: sixty halvings of [0, 9] for the upper tail that Simpson's rule gives
_TAIL = "0.003 / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({} + i * 0.003, 2) / 2)))"
_MAX_SHARPE = f"""WITH RECURSIVE {BENCH}, {NET}, ms AS (SELECT symbol, benchmark, CASE WHEN stddev_samp(excess) > 0 THEN avg(excess) / stddev_samp(excess) * sqrt(252) END AS s FROM net GROUP BY 1, 2),
mt AS (SELECT count(s) AS n, stddev_samp(s) AS sd FROM ms),
h AS (SELECT k, q, 0::DOUBLE AS lo, 9::DOUBLE AS hi, 0 AS i FROM (SELECT 1 AS k, 1.0::DOUBLE / n AS q FROM mt UNION ALL SELECT 2, 1.0::DOUBLE / (n * exp(1)) FROM mt)
  UNION ALL SELECT k, q, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, i + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, {_TAIL.format('(lo + hi) / 2')} > q AS up FROM h WHERE i < 60))
SELECT n AS n_trials, round(sd, 8) + 0.0 AS sd, round(sd * ((1 - 0.5772156649015329) * (SELECT lo FROM h WHERE i = 60 AND k = 1) + 0.5772156649015329 * (SELECT lo FROM h WHERE i = 60 AND k = 2)), 6) + 0.0 AS expected_max FROM mt"""


@query("expected_max_sharpe", _MAX_SHARPE)
def expected_max_sharpe(spark, sf):
    sharpes = bench_net(spark, sf).groupBy("symbol", "benchmark").agg(C.sharpe(F.col("excess")).alias("s")).where("s IS NOT NULL")
    row = sharpes.agg(F.count("s").alias("n"), F.stddev_samp("s").alias("sd")).first()
    out = spark.createDataFrame([(row["n"], row["sd"], I.expected_max_sharpe(row["n"], row["sd"]))], "n_trials bigint, sd double, expected_max double")
    return out.select("n_trials", (F.round("sd", 8) + 0.0).alias("sd"), (F.round("expected_max", 6) + 0.0).alias("expected_max"))


_POLITIS = f"""WITH {FRAME}, pw AS (SELECT symbol, o2c AS v, row_number() OVER ({W}) - 1 AS i FROM frame),
ps AS (SELECT symbol, count(*) AS n, avg(v) AS mu, greatest(5, ceil(log10(count(*)))) AS kn, ceil(sqrt(count(*))) + greatest(5, ceil(log10(count(*)))) AS mmax FROM pw GROUP BY 1),
pl AS (SELECT ps.*, CAST(least(mmax + kn, n - 1) AS BIGINT) AS last, unnest(range(0, CAST(least(mmax + kn, n - 1) AS BIGINT) + 1)) AS k FROM ps),
pc AS (SELECT l.symbol, l.k, any_value(n) AS n, any_value(kn) AS kn, any_value(mmax) AS mmax, any_value(last) AS last, sum((a.v - mu) * (b.v - mu)) / any_value(n) AS c FROM pl l JOIN pw a ON a.symbol = l.symbol JOIN pw b ON b.symbol = l.symbol AND b.i = a.i + l.k GROUP BY 1, 2),
pr AS (SELECT *, first_value(c) OVER (PARTITION BY symbol ORDER BY k) AS c0 FROM pc),
pf AS (SELECT *, abs(c / c0) < 2 * sqrt(log10(n) / n) AS small FROM pr WHERE k > 0),
pq AS (SELECT *, bool_and(small) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AND k + 4 <= last AS quiet FROM pf),
pm AS (SELECT symbol, coalesce(min(k) FILTER (quiet) - 1, max(k) FILTER (NOT small), 1) AS m, any_value(mmax) AS mmax, any_value(last) AS last, any_value(n) AS n, any_value(c0) AS c0 FROM pq GROUP BY 1),
pt AS (SELECT *, least(2 * greatest(m, 1), mmax, last) AS top FROM pm),
pg AS (SELECT t.symbol, any_value(t.n) AS n, 2 * sum(least(greatest(2 * (1 - q.k / top), 0), 1) * q.k * q.c) AS g, any_value(t.c0) + 2 * sum(least(greatest(2 * (1 - q.k / top), 0), 1) * q.c) AS spectrum FROM pt t JOIN pf q ON q.symbol = t.symbol AND q.k <= top GROUP BY 1)
SELECT symbol, round(CASE WHEN spectrum = 0 THEN 1 ELSE least(greatest(pow(g * g / (spectrum * spectrum), 1.0 / 3) * pow(n, 1.0 / 3), 1), ceil(least(3 * sqrt(n), n / 3.0))) END, 6) + 0.0 AS block FROM pg"""


@query("politis_white", _POLITIS)
def politis_white(spark, sf):
    return rounded(I.block_lengths(frame(spark, sf), "o2c", ["symbol"]), 6)


# ---------------------------------------------------------------- calibration

_LAB = f"{_PROBS}, lp AS (SELECT *, CASE WHEN next_o2c > 0.002 THEN 1 WHEN next_o2c < -0.002 THEN -1 ELSE 0 END AS label FROM probs)"


def labelled(spark, sf):
    y = F.when(F.col("next_o2c") > 0.002, 1).when(F.col("next_o2c") < -0.002, -1).otherwise(0)
    return probs(spark, sf).withColumn("label", y)


_BRIER = "(" + " + ".join(f"pow({c} - CASE WHEN label = {k} THEN 1 ELSE 0 END, 2)" for c, k in zip(K.P, K.CLASSES)) + ")"


@query("brier_multiclass", f"WITH {_LAB} SELECT symbol, count(*) AS n, round(avg({_BRIER}), 8) + 0.0 AS brier FROM lp GROUP BY 1")
def brier_multiclass(spark, sf):
    return rounded(labelled(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(K.brier("label")).alias("brier")))


_REF = "(pow(0.25 - CASE WHEN label = -1 THEN 1 ELSE 0 END, 2) + pow(0.5 - CASE WHEN label = 0 THEN 1 ELSE 0 END, 2) + pow(0.25 - CASE WHEN label = 1 THEN 1 ELSE 0 END, 2))"


@query("brier_skill", f"WITH {_LAB} SELECT symbol, round(1 - avg({_BRIER}) / nullif(avg({_REF}), 0), 8) + 0.0 AS skill FROM lp GROUP BY 1")
def brier_skill(spark, sf):
    return rounded(labelled(spark, sf).groupBy("symbol").agg(K.brier_skill("label", (F.lit(0.25), F.lit(0.5), F.lit(0.25))).alias("skill")))


_EDGES = ", ".join(f"({b}, {K.EDGES[b]!r}::DOUBLE, {K.EDGES[b + 1]!r}::DOUBLE)" for b in range(10))


@query(
    "reliability_curve",
    f"""WITH {_LAB}, lg AS ({' UNION ALL '.join(f"SELECT {k} AS class_label, 'raw' AS probabilities, {c} AS p, CASE WHEN label = {k} THEN 1.0 ELSE 0.0 END AS hit FROM lp" for c, k in zip(K.P, K.CLASSES))}),
e AS (SELECT * FROM (VALUES {_EDGES}) AS t(bin, lo, hi)), c AS (SELECT * FROM (VALUES (-1), (0), (1)) AS t(class_label)),
s AS (SELECT class_label, e.bin, count(*) AS n, avg(p) AS m, avg(hit) AS f FROM lg JOIN e ON p >= e.lo AND (p < e.hi OR e.bin = 9) GROUP BY 1, 2)
SELECT c.class_label, 'raw' AS probabilities, e.bin, coalesce(s.n, 0) AS n, round(s.m, 8) + 0.0 AS mean_predicted, round(s.f, 8) + 0.0 AS realised_frequency FROM c CROSS JOIN e LEFT JOIN s ON s.class_label = c.class_label AND s.bin = e.bin""",
)
def reliability_curve(spark, sf):
    return rounded(K.reliability(spark, labelled(spark, sf), "label", {"raw": K.P}))


@query(
    "majority_baseline",
    f"WITH {_LAB} SELECT symbol, {', '.join(f'round(avg(CASE WHEN label = {k} THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS rate_{n}' for k, n in zip(K.CLASSES, ('short', 'flat', 'long')))} FROM lp GROUP BY 1"
)
def majority_baseline(spark, sf):
    return rounded(labelled(spark, sf).groupBy("symbol").agg(*K.base_rates("label")))


@query(
    "binary_label_rates",
    "SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"
)
def binary_label_rates(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(j.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars")), 6)


# ---------------------------------------------------------------- text

#: Stand-ins for the licensed word list, and for two topics beside the library's own, from words that the test documents have.
LEXICON = {
    "negative": ["not", "but"], "positive": ["the", "la"], "uncertainty": ["of", "de"], "litigious": ["and", "und"],
    "strong_modal": ["is"], "weak_modal": ["was"], "constraining": ["to"]
}
TOPIC_WORDS = {"first": ("in", "en"), "second": ("on", "que")} | T.TOPICS
_IN = lambda ws: ", ".join(f"'{w}'" for w in sorted(ws))
_COUNTS = ", ".join(
    f"CAST(len(list_filter(tokens, lambda t: t IN ({_IN(ws)}))) AS BIGINT) AS {c}" for c,
    ws in [*LEXICON.items(), *((f"topic_{t}", w) for t, w in TOPIC_WORDS.items())]
)
SCORES = f"""tok AS (SELECT doc_id, CAST(DATE '2024-01-02' + CAST(doc_id % 40 AS INTEGER) AS DATE) AS session, text, regexp_extract_all(lower(text), '([a-z'']+)', 1) AS tokens FROM documents),
scores AS (SELECT doc_id, session, CAST(len(tokens) AS BIGINT) AS n_tokens, {_COUNTS} FROM tok WHERE length(text) >= 50)"""


def sessioned(spark, sf):
    """Documents dealt over 40 days; short ones count as empty."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", F.date_add(F.lit("2024-01-02").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("session"),
        F.when(F.length("text") >= 50, F.col("text")).otherwise("").alias("text")
    )


@query(
    "tokenise_counts",
    f"WITH {SCORES} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_distinct FROM tok"
)
def tokenise_counts(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def doc_scores(spark, sf):
    return T.score(sessioned(spark, sf).where(~T.is_empty(F.col("text"))), LEXICON, TOPIC_WORDS, ["doc_id", "session"])


@query("lexicon_scores", f"WITH {SCORES} SELECT * FROM scores")
def lexicon_scores(spark, sf):
    return doc_scores(spark, sf)


_RATES = [*LEXICON, *(f"topic_{t}" for t in TOPIC_WORDS)]
_DAYS = "days AS (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY)) AS DATE) AS session)"
_TEXTF = f"""{SCORES}, {_DAYS}, sums AS (SELECT session, count(*) AS doc_count, sum(n_tokens) AS n_tokens, {', '.join(f'sum({c}) AS {c}' for c in _RATES)} FROM scores GROUP BY 1),
emp AS (SELECT session, count(*) AS n_empty FROM tok WHERE length(text) < 50 GROUP BY 1)"""
_CELLS = "CAST(coalesce(doc_count, 0) AS DOUBLE) AS docs_doc_count, CAST(coalesce(n_tokens, 0) AS DOUBLE) AS docs_token_count, round(coalesce(CAST(positive - negative AS DOUBLE) / nullif(positive + negative, 0), 0), 8) + 0.0 AS docs_tone, " + ", ".join(
    f"round(coalesce(CAST({c} AS DOUBLE) / nullif(n_tokens, 0), 0), 8) + 0.0 AS docs_{c}_rate" for c in _RATES
)


def session_text(spark, sf):
    spine = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-02-14')) AS session")
    return T.session_features(doc_scores(spark, sf), spine, LEXICON, TOPIC_WORDS, "docs_")


@query(
    "session_text_features",
    f"WITH {_TEXTF} SELECT session, {_CELLS}, CAST(coalesce(n_empty, 0) AS DOUBLE) AS empty_count FROM days LEFT JOIN sums USING (session) LEFT JOIN emp USING (session)"
)
def session_text_features(spark, sf):
    return rounded(T.with_empty_counts(session_text(spark, sf), sessioned(spark, sf), "empty_count"))


@query(
    "topic_rates",
    f"WITH {SCORES} SELECT session, {', '.join(f'round(CAST(sum(topic_{t}) AS DOUBLE) / nullif(sum(n_tokens), 0), 8) + 0.0 AS {t}_rate' for t in TOPIC_WORDS)} FROM scores GROUP BY 1"
)
def topic_rates(spark, sf):
    s = doc_scores(spark, sf)
    return rounded(s.groupBy("session").agg(*(F.try_divide(F.sum(f"topic_{t}").cast("double"), F.sum("n_tokens")).alias(f"{t}_rate") for t in TOPIC_WORDS)))


_TOPIC_WORDS = ", ".join(f"('{t}', '{w}')" for t, ws in T.TOPICS.items() for w in sorted(set(ws)))


@query(
    "topic_registry",
    f"""WITH tw AS (SELECT * FROM (VALUES {_TOPIC_WORDS}) AS t(topic, word)), tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z'']+)', 1)) AS word FROM documents)
SELECT topic, count(DISTINCT tw.word) AS n_words, count(tk.word) AS n_tokens, count(DISTINCT doc_id) AS n_documents FROM tw LEFT JOIN tk USING (word) GROUP BY 1""",
)
def topic_registry(spark, sf):
    """The topics' lists beside what the documents hold of them."""
    scored = T.score(table(spark, sf, "documents"), {}, T.TOPICS, ["doc_id"])
    cells = F.inline(F.array(*(F.struct(F.lit(t).alias("topic"), F.col(f"topic_{t}").alias("k")) for t in T.TOPICS)))
    held = scored.select("doc_id", cells).groupBy("topic").agg(F.sum("k").alias("n_tokens"), F.count_if(F.col("k") > 0).alias("n_documents"))
    known = spark.createDataFrame([(t, len(set(w))) for t, w in T.TOPICS.items()], "topic string, n_words long")
    return known.join(held, "topic", "left").na.fill(0)


@query("page_fields")
def page_fields(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", files.parse_page("html").alias("p"))
    return p.select(
        "page_id", F.regexp_extract("url", r"^(?:https?://)?([^/]+)", 1).alias("host"), F.col("p.title").alias("title"),
        F.col("p.n_links").alias("n_links"), F.length("p.body").alias("body_chars")
    )


@query(
    "discovery_frontier",
    "SELECT regexp_extract(url, '^(?:https?://)?([^/]+)', 1) AS host, count(DISTINCT url) AS n_new FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY 1"
)
def discovery_frontier(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    new = files.new_items(p, p.where("page_id % 3 = 0"), "url")
    return new.groupBy(F.regexp_extract("url", r"^(?:https?://)?([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n_new"))


@query(
    "seeded_stratified_sample",
    "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 25"
)
def seeded_stratified_sample(spark, sf):
    return files.seeded_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 25, 7)


@query(
    "empty_row_diagnosis",
    "SELECT source, count(*) AS n, CAST(count(*) FILTER (length(text) < 50) AS BIGINT) AS n_empty, round(avg(CASE WHEN length(text) < 50 THEN 1.0 ELSE 0.0 END), 8) AS empty_share FROM documents GROUP BY 1"
)
def empty_row_diagnosis(spark, sf):
    e = F.length("text") < 50
    return rounded(
        table(spark, sf, "documents").groupBy("source").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(e).alias("n_empty"), F.avg(e.cast("double")).alias("empty_share")
        )
    )


# ---------------------------------------------------------------- audit

_COLS = ("close", "high", "low")


@query(
    "run_diff",
    f"WITH {BARS}, b AS (SELECT session, round(close, 1) AS close, high, round(low, 2) AS low FROM bars WHERE day(session) <> 13) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (b.session IS NULL) AS n_one_sided, count(b.{c}) AS n_both, count(*) FILTER (b.session IS NOT NULL AND abs(a.{c} - b.{c}) > 1e-9) AS n_different, round(coalesce(max(abs(a.{c} - b.{c})), 0), 8) + 0.0 AS max_abs, round(coalesce(max(abs(a.{c} - b.{c}) / abs(a.{c})), 0), 8) + 0.0 AS max_rel FROM bars a LEFT JOIN b USING (session)"
        for c in _COLS
    ),
)
def run_diff(spark, sf):
    a = market_bars(spark, sf).select("session", *_COLS)
    b = a.where(F.dayofmonth("session") != 13).select("session", F.round("close", 1).alias("close"), "high", F.round("low", 2).alias("low"))
    return rounded(A.run_diff(a, b, ["session"], list(_COLS), 1e-9))


_BAR = ("open", "high", "low", "close", "volume")
_LATER = """later AS (
  SELECT CAST(o_orderdate AS DATE) AS session, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)"""


@query(
    "vintage_diff",
    f"WITH {BARS}, {_LATER}, j AS (SELECT coalesce(a.session, b.session) AS session, (a.session IS NULL OR b.session IS NULL) AS one, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in _BAR)} FROM bars a FULL JOIN later b ON a.session = b.session) "
    + " UNION ALL ".join(
        f"SELECT year(session) AS year, '{c}' AS column_name, count(*) FILTER (one) AS n_one_sided, count(*) FILTER (NOT one AND abs(a_{c} - b_{c}) > 1e-9) AS n_cells, round(coalesce(max(abs(a_{c} - b_{c})), 0), 6) + 0.0 AS max_abs, round(coalesce(max(abs(a_{c} - b_{c}) / nullif(abs(a_{c}), 0)), 0), 8) + 0.0 AS max_rel FROM j GROUP BY 1"
        for c in _BAR
    ),
)
def vintage_diff(spark, sf):
    """Bars of all orders against a vintage in which one priority is still missing."""
    a = market_bars(spark, sf).select("session", *_BAR)
    later = to_bars(table(spark, sf, "orders").where("o_orderpriority != '5-LOW'"), F.lit("ALL"), F.to_date("o_orderdate"), "o_totalprice", "o_orderkey")
    out = A.vintage_diff(a, later.select("session", *_BAR), ["session"], list(_BAR), F.year("session").cast("long"), "year", 1e-9)
    return rounded(out.withColumn("max_abs", F.round("max_abs", 6)))


@query(
    "row_digests",
    "SELECT o_orderkey, sha256(coalesce(CAST(o_orderkey AS VARCHAR), 'NULL') || '|' || coalesce(CAST(o_custkey AS VARCHAR), 'NULL') || '|' || coalesce(o_orderstatus, 'NULL')) AS digest FROM orders"
)
def row_digests(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", files.row_digest("o_orderkey", "o_custkey", "o_orderstatus").alias("digest"))


_REG = "reg AS (SELECT 'E' || CAST(n_nationkey + 1 AS VARCHAR) AS experiment_id, CASE WHEN n_nationkey % 3 = 0 THEN 'no' ELSE 'yes' END AS counts_toward_budget FROM nation)"


def registry(spark, sf):
    n = table(spark, sf, "nation")
    return A.as_registry(
        n.select(
            F.concat(F.lit("E"), (F.col("n_nationkey") + 1).cast("string")).alias("experiment_id"),
            F.when(F.col("n_nationkey") % 3 == 0, "no").otherwise("yes").alias("counts_toward_budget")
        )
    )


@query(
    "registry_budget",
    f"WITH {_REG} SELECT count(*) FILTER (counts_toward_budget = 'yes') AS n_counted, count(*) FILTER (counts_toward_budget <> 'yes') AS n_excluded FROM reg"
)
def registry_budget(spark, sf):
    return A.registry_budget(registry(spark, sf))


@query(
    "range_expand_ids",
    """WITH b AS (SELECT c_nationkey, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1)
SELECT 'C' || CAST(i AS VARCHAR) AS id FROM (SELECT unnest(range(lo, lo + 4)) AS i FROM b UNION SELECT hi FROM b)""",
)
def range_expand_ids(spark, sf):
    """Lists such as `C3-C6, C140`, one a nation: its first customer with the three ids after it, and its last."""
    lo, hi = F.min("c_custkey"), F.max("c_custkey")
    lists = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.format_string("C%d-C%d, C%d", lo, lo + 3, hi).alias("ids"))
    return A.expand_ids(lists, "ids")


@query(
    "registry_contract",
    f"WITH {_REG}, x AS (SELECT 'E' || CAST(i AS VARCHAR) AS id FROM (SELECT unnest(range(1, 31)) AS i)) SELECT 'missing' AS side, id FROM x WHERE id NOT IN (SELECT experiment_id FROM reg) UNION ALL SELECT 'unexpected', experiment_id FROM reg WHERE experiment_id NOT IN (SELECT id FROM x)"
)
def registry_contract(spark, sf):
    want = A.expand_ids(spark.createDataFrame([("E1-E30",)], "ids string"), "ids")
    return A.missing_ids(want, registry(spark, sf).select(F.col("experiment_id").alias("id")), "id")


@query(
    "registry_natural_order",
    f"WITH {_REG} SELECT experiment_id, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(experiment_id, '(\\d+)', 1) AS INTEGER)) AS INTEGER) AS position FROM reg"
)
def registry_natural_order(spark, sf):
    return registry(spark, sf).select(
        "experiment_id",
        F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*A.natural_order("experiment_id"))).alias("position")
    )


@query(
    "governance_max_text",
    "SELECT 'text' AS column_name, max(length(text)) AS max_length, count(*) FILTER (length(text) > 200) AS n_over FROM documents UNION ALL SELECT 'lang', max(length(lang)), count(*) FILTER (length(lang) > 200) FROM documents UNION ALL SELECT 'source', max(length(source)), count(*) FILTER (length(source) > 200) FROM documents"
)
def governance_max_text(spark, sf):
    return A.text_lengths(table(spark, sf, "documents").select("text", "lang", "source"))


@query("event_json_fields", "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY 1")
def event_json_fields(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("sum_k")
    )


@query(
    "financing_reconstruction",
    f"WITH {SNAPSHOT}, f AS (SELECT symbol, session, coalesce(lag(dgs3mo) OVER ({W}) / 100 * session_minutes / (365.0 * 24 * 60), 0) AS a, coalesce(lag(round(dgs3mo, 2)) OVER ({W}) / 100 * session_minutes / (365.0 * 24 * 60), 0) AS b FROM snap) SELECT symbol, count(*) AS n_both, CAST(count(*) FILTER (abs(a - b) <= 1e-12) AS BIGINT) AS n_identical, round(max(abs(a - b)), 10) + 0.0 AS max_abs FROM f GROUP BY 1"
)
def financing_reconstruction(spark, sf):
    s = snapshot(spark, sf)
    f = s.select("symbol", "session", "dgs3mo", "session_minutes", F.round("dgs3mo", 2).alias("other"))
    f = f.select("symbol", E.intraday_financing().alias("a"), E.intraday_financing("other").alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return rounded(f.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_both"), F.count_if(d <= 1e-12).alias("n_identical"), F.max(d).alias("max_abs")), 10)

