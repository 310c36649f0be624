"""Volatility-adjusted targets, fold-local thresholds and labels, fold geometry."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import prefix_quantiles

LOW, HIGH, TINY = 0.25, 0.75, 1e-8


def vol_adjusted(target: Column, vol: Column) -> Column:
    return F.when(target > -1, F.log1p(target)) / (vol + TINY)


def thresholds(z: str = "z") -> list[Column]:
    return [F.percentile(z, F.lit(LOW)).alias("q_lo"), F.percentile(z, F.lit(HIGH)).alias("q_hi")]


def label(z: Column, q_lo: Column, q_hi: Column) -> Column:
    """1 at or above q_hi (also if q_lo is met), -1 at or below q_lo, else 0."""
    return F.when(z >= q_hi, 1).when(z <= q_lo, -1).when(z.isNotNull(), 0)


def positions_in_order(df: DataFrame, by: list[str] = ["symbol"]) -> DataFrame:
    """pos from 0 in session order."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("session")).cast("long") - 1)


def time_series_split(n: int, n_splits: int, test_size: int, gap: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(train start, train end, test start, test end) of each fold, ends not included; folds do not overlap and come in order."""
    first = n - n_splits * test_size
    if first - gap <= 0:
        raise ValueError(f"{n} rows are too few for {n_splits} folds of {test_size} with a gap of {gap}")
    for i in range(n_splits):
        start = first + i * test_size
        yield 0, start - gap, start, start + test_size


def outer_steps(n: int, initial: int, step: int, retune_every: int, rolling: int | None = None) -> list[dict]:
    """Walk-forward blocks of `step` rows, the last one as long as rows remain; retune marks where candidates are compared anew."""
    return [
        {
            "step": k, "train_lo": 0 if rolling is None else max(0, s - rolling), "train_hi": s, "test_lo": s,
            "test_hi": min(s + step, n), "retune": int(k % retune_every == 0)
        }
        for k, s in enumerate(range(initial, n, step))
    ]


def step_thresholds(rows: DataFrame, initial: int, step: int) -> DataFrame:
    """symbol, step, q_lo, q_hi, n_train: thresholds of every expanding slice, rows(symbol, pos, z); z is never missing."""
    end = (F.col("n") >= initial) & (F.col("n") < F.col("__all")) & ((F.col("n") - initial) % step == 0)
    found = prefix_quantiles(rows, ["symbol"], "pos", "z", [LOW, HIGH], end)
    of = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    return found.groupBy("symbol", "n").agg(of(LOW).alias("q_lo"), of(HIGH).alias("q_hi")).select(
        "symbol", ((F.col("n") - initial) / step).cast("int").alias("step"), "q_lo", "q_hi", F.col("n").alias("n_train")
    )


def class_means(r: str, y: str) -> list[Column]:
    """Mean return of each class; 0 for an empty one."""
    return [F.coalesce(F.avg(F.when(F.col(y) == c, F.col(r))), F.lit(0.0)).alias(n) for c, n in ((-1, "mean_short"), (0, "mean_flat"), (1, "mean_long"))]


def expected_return(p: tuple[str, str, str], m: tuple[str, str, str]) -> Column:
    return sum((F.col(a) * F.col(b) for a, b in zip(p, m)), F.lit(0.0))
