"""Tables of runs: scores in the order of specifications, paired intervals against one run, and the verdict of a run.

Runs are rows (run, spec, session, model, weight, net, own, cash): own is the net return of always-long under the run's own
specification on the same row, cash what unused money earns. A run has a session once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as C
from . import inference as I
from .audit import natural_order

LEAST_SHARED = 250
NO_POSITION, SUPPORTED, UNSUPPORTED = "no position taken", "supported", "not supported"


def scores(runs: DataFrame) -> DataFrame:
    """One row a run: sessions, mean, Sharpe ratio, activity, wealth, models, and the Sharpe ratio against its own always-long."""
    active = F.col("weight") != 0
    return runs.groupBy("run", "spec").agg(
        F.count(F.lit(1)).alias("oos_sessions"), (F.avg("net") * C.TRADING_DAYS).alias("ann_mean_excess"), C.sharpe(F.col("net")).alias("sharpe"),
        F.avg(active.cast("double")).alias("participation"), F.count_if(active).alias("n_active"),
        F.product(1.0 + F.col("net") + F.coalesce("cash", F.lit(0.0))).alias("terminal_wealth"),
        (C.sharpe(F.col("net")) - C.sharpe(F.col("own"))).alias("sharpe_vs_always_long"), F.countDistinct("model").alias("models_selected")
    )


def shared_rows(runs: DataFrame, base: str) -> DataFrame:
    """run, session, x, y: net returns of each other run and of the base on the sessions that both have, under one specification."""
    b = runs.where(F.col("run") == base).select("spec", "session", F.col("net").alias("y"))
    return runs.where(F.col("run") != base).join(b, ["spec", "session"]).select("run", "session", F.col("net").alias("x"), "y")


def paired_draws(rows: DataFrame, statistics: dict[str, Column], least: int = 0, replicates: int = I.REPLICATES, seed: int = I.SEED) -> DataFrame:
    """run, rep and statistics (of the sums of moments x, y), for runs of more than `least` rows (run, session, x, y).

    Runs of one length share their paths. The driver reads the lengths, one number a run.
    """
    each = I.indexed(rows, ["run"])
    lengths: dict[int, list[str]] = {}
    for r in each.groupBy("run").count().where(F.col("count") > least).collect():
        lengths.setdefault(r["count"], []).append(r["run"])
    sums = I.moments("x", "y")
    drawn = [I.draws(each.where(F.col("run").isin(ids)), n, sums, statistics, replicates, seed=seed, by=["run"]) for n, ids in sorted(lengths.items())]
    if not drawn:
        return each.select("run", F.lit(0).cast("bigint").alias("rep"), *(F.lit(None).cast("double").alias(k) for k in statistics)).limit(0)
    return reduce(DataFrame.unionByName, drawn)


def intervals(drawn: DataFrame, names: list[str]) -> DataFrame:
    """run and, for each statistic, its 95% percentile interval <name>_lo and <name>_hi."""
    ends = [F.percentile(k, F.lit(q)).alias(f"{k}_{end}") for k in names for q, end in ((0.025, "lo"), (0.975, "hi"))]
    return drawn.groupBy("run").agg(*ends)


def in_order(table: DataFrame, base: str) -> DataFrame:
    """The table with `place` from 1: the base first, then by specification; a row a run, so one task sorts it."""
    w = Window.orderBy((F.col("run") != base).cast("int"), *natural_order("run"))
    return table.withColumn("place", F.row_number().over(w))


def comparison(runs: DataFrame, base: str, least: int = LEAST_SHARED, replicates: int = I.REPLICATES) -> DataFrame:
    """Scores of all runs, in the order of specifications and not of scores; for runs of the base's specification also n_shared and,
    with more than `least` shared sessions, the paired difference of Sharpe ratios with its interval.
    """
    rows = shared_rows(runs, base)
    enough = F.count(F.lit(1)) > least
    point = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n_shared"), F.when(enough, C.sharpe(F.col("x")) - C.sharpe(F.col("y"))).alias("diff"))
    drawn = paired_draws(rows, {"diff": I.moment_sharpe("x") - I.moment_sharpe("y")}, least, replicates)
    return in_order(scores(runs).join(point, "run", "left").join(intervals(drawn, ["diff"]), "run", "left"), base)


def verdict(participation: Column, against_benchmark_low: Column, against_cash_low: Column) -> Column:
    """Both lower bounds must exceed 0; a run that never trades is named as such."""
    both = F.coalesce((against_benchmark_low > 0) & (against_cash_low > 0), F.lit(False))
    return F.when(participation == 0, NO_POSITION).when(both, SUPPORTED).otherwise(UNSUPPORTED)


def evaluation(runs: DataFrame, replicates: int = I.REPLICATES) -> DataFrame:
    """run, participation, condition A (Sharpe ratio against its own always-long), B (mean against cash), each with interval, and the verdict."""
    point = runs.groupBy("run").agg(
        F.avg((F.col("weight") != 0).cast("double")).alias("participation"), (C.sharpe(F.col("net")) - C.sharpe(F.col("own"))).alias("a"),
        (F.avg("net") * C.TRADING_DAYS).alias("b")
    )
    rows = runs.select("run", "session", F.col("net").alias("x"), F.col("own").alias("y"))
    parts = {"a": I.moment_sharpe("x") - I.moment_sharpe("y"), "b": I.moment_mean("x", float(C.TRADING_DAYS))}
    out = point.join(intervals(paired_draws(rows, parts, 0, replicates), list(parts)), "run", "left")
    return out.withColumn("verdict", verdict(F.col("participation"), F.col("a_lo"), F.col("b_lo")))
