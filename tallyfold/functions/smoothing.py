"""Exponential means, as scans of affine maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import scan


def _source(text: str) -> Column:
    a, _, b = text.partition(" - ")
    x = F.col(a).cast("double") - F.col(b).cast("double") if b else F.col(a).cast("double")
    return F.when(~F.isnan(x), x)


def smooth(df: DataFrame, outputs: dict[str, tuple[str, float, int]], symbol: str = "symbol", session: str = "session") -> DataFrame:
    """Adds each output = (input, alpha, min_periods): y1 = x1, yt = (1 - alpha) y(t-1) + alpha xt, within a symbol.

    Missing inputs leave the value as it was, and count for the weights of what comes after; the output is
    NULL until min_periods values have been seen. An input is a column, an earlier output, or the difference
    `a - b` of two; outputs that need no other one share a scan.
    """
    stages: list[dict[str, tuple[str, float, int]]] = [{}]
    for name, spec in outputs.items():
        if set(spec[0].split(" - ")) & set(stages[-1]):
            stages.append({})
        stages[-1][name] = spec
    order = Window.partitionBy(symbol).orderBy(session)
    d = df.withColumn("__at", F.row_number().over(order).cast("bigint") - 1)
    for stage in stages:
        d = _smooth_all(d, stage, symbol, order)
    return d.drop("__at")


def _smooth_all(d: DataFrame, outputs: dict[str, tuple[str, float, int]], symbol: str, order) -> DataFrame:
    """A row maps y to k y + c, and n to n + its values; for a missing input k = 1, for the first value k = 0."""
    columns, parts = d.columns, []
    for i, (source, alpha, _) in enumerate(outputs.values()):
        x = _source(source)
        since = F.col("__at") - F.last(F.when(x.isNotNull(), F.col("__at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        old = F.pow(F.lit(1.0 - alpha), since)
        parts += [
            F.when(x.isNull(), 1.0).when(since.isNull(), 0.0).otherwise(old / (old + alpha)).alias(f"k{i}"),
            F.when(x.isNull(), 0.0).when(since.isNull(), x).otherwise(alpha * x / (old + alpha)).alias(f"c{i}"), x.isNotNull().cast("bigint").alias(f"n{i}")
        ]
    n = range(len(outputs))
    compose = lambda f, g: "struct(" + ", ".join(f"{f}.k{i} * {g}.k{i} AS k{i}, {g}.k{i} * {f}.c{i} + {g}.c{i} AS c{i}, {f}.n{i} + {g}.n{i} AS n{i}" for i in n) + ")"
    apply = lambda m, s: "struct(" + ", ".join(f"{m}.k{i} * {s}.y{i} + {m}.c{i} AS y{i}, {s}.n{i} + {m}.n{i} AS n{i}" for i in n) + ")"
    start = "struct(" + ", ".join(f"cast(0 as double) AS y{i}, cast(0 as bigint) AS n{i}" for i in n) + ")"
    out = scan(d.withColumn("m", F.struct(*parts)), [symbol], "__at", start, compose, apply, "__state")
    made = [F.when(F.col(f"__state.n{i}") >= max(least, 1), F.col(f"__state.y{i}")).alias(name) for i, (name, (_, _, least)) in enumerate(outputs.items())]
    return out.select(*(F.col(f"`{c}`") for c in columns), *made)
