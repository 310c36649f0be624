"""Tables of runs on the series of all orders: exploratory runs, arms of an increment, and the verdict."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import execution as E
from ..operators import inference as I
from ..operators import runs as R
from .base import MARKET, SNAPSHOT, once, query, rnd, rounded
from .execution_queries import BENCH, COST, DECIDE, NET, bench, decide
from .research_queries import _H, _SR, REPS, SEED

_FROM = dt.date(1900, 1, 1)
#: run -> benchmark and first session; the last one, close-to-close, is under another specification
OPEN_RUNS = {"P1": ("prior_open_close", _FROM), "E2": ("momentum_5", _FROM), "E10": ("reversal_5", dt.date(1997, 1, 1)), "E4": ("cash", _FROM)}
CLOSE_RUN, CLOSE_WEIGHT = "E3", "prior_close_close"
COLUMNS = ["run", "spec", "session", "model", "weight", "net", "own", "cash"]

_LISTED = ", ".join(f"('{r}', '{b}', DATE '{d}')" for r, (b, d) in OPEN_RUNS.items())
RUNS = f"""{BENCH.replace(SNAPSHOT, MARKET)}, {NET},
ro AS (SELECT run, 'open_to_close' AS spec, session, benchmark AS model, weight, excess AS net, o2c - 2 * {COST} / 1e4 - financing AS own, rf AS cash
  FROM net JOIN (VALUES {_LISTED}) AS t(run, benchmark, lo) USING (benchmark) WHERE session >= lo),
rc AS (SELECT '{CLOSE_RUN}' AS run, 'close_to_close' AS spec, session, benchmark AS model, weight,
    weight * (coalesce(c2c, 0) - rf) - {COST} / 1e4 * abs(weight - coalesce(lag(weight) OVER z, 0))
      - {E.BORROW_BPS} / 1e4 * (coalesce(date_diff('day', lag(session) OVER z, session), 1) / 365.0) * greatest(-weight, 0) AS net,
    coalesce(c2c, 0) - rf - {COST} / 1e4 * (1 - coalesce(lag(1) OVER z, 0)) AS own, rf AS cash
  FROM bench WHERE benchmark = '{CLOSE_WEIGHT}' WINDOW z AS (ORDER BY session)),
runs AS (SELECT * FROM ro UNION ALL SELECT * FROM rc)"""


def exploratory_runs(spark, sf):
    d = bench(spark, sf, True)
    listed = spark.createDataFrame([(r, *v) for r, v in OPEN_RUNS.items()], "run string, benchmark string, lo date")
    always = E.open_close_net(F.lit(1.0), F.col("o2c"), F.col("financing"), COST)
    o = d.join(listed, "benchmark").where("session >= lo").select(
        "run", F.lit("open_to_close").alias("spec"), "session", F.col("benchmark").alias("model"), "weight",
        E.open_close_net(F.col("weight"), F.col("o2c"), F.col("financing"), COST).alias("net"), always.alias("own"), F.col("rf").alias("cash")
    )
    k = d.where(F.col("benchmark") == CLOSE_WEIGHT).na.fill(0.0, ["c2c"]).withColumn("one", F.lit(1.0))
    k = E.close_close_same_row(E.close_close_same_row(k, "weight", "c2c", "rf", COST), "one", "c2c", "rf", COST, name="own")
    k = k.select(
        F.lit(CLOSE_RUN).alias("run"), F.lit("close_to_close").alias("spec"), "session", F.col("benchmark").alias("model"), "weight", "net", "own",
        F.col("rf").alias("cash")
    )
    return o.unionByName(k)


_PATHS = f"""bg AS (SELECT rep, n, unnest(range(0, n)) AS i FROM (SELECT DISTINCT n FROM shared), (SELECT unnest(range(0, {REPS})) AS rep)),
bh AS (SELECT rep, i, n, CASE WHEN i = 0 OR {_H.format(seed=SEED, tag='r')} / 4294967296.0 < 1 / {I.BLOCK} THEN {_H.format(seed=SEED, tag='s')} % n END AS start FROM bg),
bp AS (SELECT rep, i, n, last_value(start IGNORE NULLS) OVER z AS s0, last_value(CASE WHEN start IS NOT NULL THEN i END IGNORE NULLS) OVER z AS i0 FROM bh WINDOW z AS (PARTITION BY n, rep ORDER BY i ROWS UNBOUNDED PRECEDING)),
path AS (SELECT rep, n, (s0 + i - i0) % n AS idx FROM bp)"""
_DIFF = f"{_SR.format('x')} - {_SR.format('y')}"


def _comparison_sql(runs: str, base: str, least: int, extra: str = "") -> str:
    return f"""WITH {runs},
sc AS (SELECT run, spec, count(*) AS oos_sessions, avg(net) * 252 AS ann_mean_excess, {_SR.format('net')} AS sharpe, avg(CASE WHEN weight <> 0 THEN 1.0 ELSE 0.0 END) AS participation,
  CAST(sum(CASE WHEN weight <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_active, product(1 + net + coalesce(cash, 0)) AS terminal_wealth, {_SR.format('net')} - {_SR.format('own')} AS sharpe_vs_always_long,
  count(DISTINCT model) AS models_selected FROM runs GROUP BY 1, 2),
met AS (SELECT a.run, a.session, a.net AS x, b.net AS y, count(*) OVER (PARTITION BY a.run) AS n FROM runs a JOIN runs b USING (spec, session) WHERE a.run <> '{base}' AND b.run = '{base}'),
shared AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY session) - 1 AS idx FROM met WHERE n > {least}), {_PATHS},
pt AS (SELECT run, count(*) AS n_shared, CASE WHEN count(*) > {least} THEN {_DIFF} END AS diff FROM met GROUP BY 1),
dr AS (SELECT run, rep, {_DIFF} AS s FROM path JOIN shared USING (n, idx) GROUP BY 1, 2),
ci AS (SELECT run, quantile_cont(s, 0.025) AS diff_lo, quantile_cont(s, 0.975) AS diff_hi FROM dr GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY run <> '{base}', CAST(regexp_extract(run, '[0-9]+') AS INTEGER), run) AS INTEGER) AS place, run, spec, {extra} oos_sessions, n_active, models_selected, n_shared,
  {rnd('ann_mean_excess', 'sharpe', 'participation', 'sharpe_vs_always_long', 'diff', 'diff_lo', 'diff_hi', digits=6)}, round(CASE WHEN terminal_wealth > 0 THEN ln(terminal_wealth) END, 6) + 0.0 AS log_wealth
FROM sc LEFT JOIN pt USING (run) LEFT JOIN ci USING (run)"""


def _shown(table):
    """Wealth as its logarithm: that of the leakage control has more digits than a double."""
    return rounded(table.withColumn("log_wealth", C.log(F.col("terminal_wealth"))).drop("terminal_wealth"), 6)


@query("exploratory_table", _comparison_sql(RUNS, "P1", R.LEAST_SHARED))
def exploratory_table(spark, sf):
    return _shown(R.comparison(once(exploratory_runs(spark, sf)), "P1"))


@query(
    "evaluation_verdict",
    f"""WITH {RUNS}, chosen AS (SELECT * FROM runs WHERE run <> '{CLOSE_RUN}' AND run <> 'E10'),
shared AS (SELECT run, net AS x, own AS y, row_number() OVER (PARTITION BY run ORDER BY session) - 1 AS idx, count(*) OVER (PARTITION BY run) AS n FROM chosen), {_PATHS},
pt AS (SELECT run, avg(CASE WHEN weight <> 0 THEN 1.0 ELSE 0.0 END) AS participation, {_SR.format('net')} - {_SR.format('own')} AS a, avg(net) * 252 AS b FROM chosen GROUP BY 1),
dr AS (SELECT run, rep, {_DIFF} AS a, avg(x) * 252 AS b FROM path JOIN shared USING (n, idx) GROUP BY 1, 2),
ci AS (SELECT run, quantile_cont(a, 0.025) AS a_lo, quantile_cont(a, 0.975) AS a_hi, quantile_cont(b, 0.025) AS b_lo, quantile_cont(b, 0.975) AS b_hi FROM dr GROUP BY 1)
SELECT run, {rnd('participation', 'a', 'b', 'a_lo', 'a_hi', 'b_lo', 'b_hi', digits=6)},
  CASE WHEN participation = 0 THEN '{R.NO_POSITION}' WHEN a_lo > 0 AND b_lo > 0 THEN '{R.SUPPORTED}' ELSE '{R.UNSUPPORTED}' END AS verdict FROM pt LEFT JOIN ci USING (run)""",
)
def evaluation_verdict(spark, sf):
    runs = exploratory_runs(spark, sf).where(f"run NOT IN ('{CLOSE_RUN}', 'E10')")
    return rounded(R.evaluation(once(runs)), 6)


# arms of one forecast: as it is (N0), with one more term of the past (N1), and with one of the future, a leakage control (N1m)
_ARM = "CASE WHEN {0} > band THEN 1.0 WHEN {0} < -band THEN -1.0 ELSE 0.0 END::DOUBLE"
ARMS = f"""{DECIDE.replace(SNAPSHOT, MARKET)}, am AS (SELECT *, coalesce(lag(mu) OVER (PARTITION BY symbol ORDER BY session), 0) AS past FROM decide),
aw AS (SELECT session, run, next_o2c, next_financing, next_rf, CASE run WHEN 'N0' THEN {_ARM.format('mu')} WHEN 'N1' THEN {_ARM.format('(mu + 0.5 * past)')} ELSE {_ARM.format('(mu + 0.01 * next_o2c)')} END AS weight
  FROM am, (VALUES ('N0'), ('N1'), ('N1m')) AS t(run)),
runs AS (SELECT run, 'open_to_close' AS spec, session, run AS model, weight, weight * next_o2c - 2 * {COST} / 1e4 * abs(weight) - next_financing * abs(weight) AS net,
  next_o2c - 2 * {COST} / 1e4 - next_financing AS own, next_rf AS cash FROM aw)"""


def arms(spark, sf):
    past = F.coalesce(F.lag("mu").over(C.series()), F.lit(0.0))
    d = decide(spark, sf, True).withColumn("past", past)
    mus = {"N0": F.col("mu"), "N1": F.col("mu") + 0.5 * F.col("past"), "N1m": F.col("mu") + 0.01 * F.col("next_o2c")}
    one = [F.struct(F.lit(k).alias("run"), E.threshold_positions(m, F.col("band")).alias("weight")) for k, m in mus.items()]
    d = d.select("session", "next_o2c", "next_financing", F.col("next_rf").alias("cash"), F.inline(F.array(*one)))
    net = lambda w: E.open_close_net(w, F.col("next_o2c"), F.col("next_financing"), COST)
    return d.withColumns({"spec": F.lit("open_to_close"), "model": F.col("run"), "net": net(F.col("weight")), "own": net(F.lit(1.0))}).select(*COLUMNS)


@query("incremental_table", _comparison_sql(ARMS, "N0", 0, "CASE WHEN run = 'N0' THEN 'control' WHEN run LIKE '%m' THEN 'leakage control' ELSE 'treated' END AS kind,"))
def incremental_table(spark, sf):
    kind = F.when(F.col("run") == "N0", "control").when(F.col("run").endswith("m"), "leakage control").otherwise("treated")
    return _shown(R.comparison(once(arms(spark, sf)), "N0", 0).withColumn("kind", kind))
