"""Associative scans along series, in Column functions: what a row does to a state is a value that can be composed.

A series is cut into blocks of BLOCK rows. Each block composes its rows into one value, the blocks' values are scanned
in the same way, and each block then applies its rows to the state that it begins with. So a series is in as many
tasks as it has blocks, and only the blocks' values of one series come together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128


def scan(
    rows: DataFrame, by: list[str], at: str, start: str, compose: Callable[[str, str], str], apply: Callable[[str, str], str],
    name: str = "state", levels: int = 1
) -> DataFrame:
    """rows without m, with the state after each row as name.

    rows has `at`, the place in its series (by) from 0, and m, what the row does. start is the SQL of the state before
    the first row; compose(f, g) that of f and then g; apply(m, s) that of the state after m. With more levels the blocks'
    values are cut into blocks as well: levels = 1 does for series of a million rows.
    """
    rest = [c for c in rows.columns if c not in by]
    block = [] if levels == 0 else [F.expr(f"`{at}` div {BLOCK}").alias("__block")]
    one = F.struct(F.col(at).alias("__at"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("__row"))
    blocks = rows.groupBy(*by, *block).agg(F.array_sort(F.collect_list(one)).alias("__all"))
    if levels == 0:
        carried = blocks.withColumn("__carry", F.expr(start))
    else:
        whole = f"aggregate(slice(__all, 2, size(__all)), __all[0].__row.m, (f, x) -> {compose('f', 'x.__row.m')})"
        totals = blocks.select(*by, F.col("__block").alias(at), F.expr(whole).alias("m"))
        ends = scan(totals, by, at, start, compose, apply, "__end", levels - 1).select(*by, (F.col(at) + 1).alias("__block"), "__end")
        carried = blocks.join(ends, [*by, "__block"], "left").withColumn("__carry", F.coalesce("__end", F.expr(start)))
    states = F.expr(f"aggregate(__all, array(__carry), (out, x) -> array_append(out, {apply('x.__row.m', 'element_at(out, -1)')}))")
    out = carried.select(*by, F.posexplode(F.arrays_zip(F.col("__all").alias("x"), F.slice(states, F.lit(2), F.size("__all")).alias("s"))).alias("__i", "__y"))
    return out.select(*by, *(F.col(f"__y.x.__row.`{c}`").alias(c) for c in rest if c != "m"), F.col("__y.s").alias(name))


def running_sums(rows: DataFrame, by: list[str], at: str, columns: list[str]) -> DataFrame:
    """by, at, columns: sums over the rows of the series up to `at`."""
    fields = {c: f"v{i}" for i, c in enumerate(columns)}
    m = F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(v) for c, v in fields.items()))
    add = lambda f, g: "struct(" + ", ".join(f"{f}.{v} + {g}.{v} AS {v}" for v in fields.values()) + ")"
    zero = "struct(" + ", ".join(f"cast(0 as double) AS {v}" for v in fields.values()) + ")"
    out = scan(rows.select(*by, at, m.alias("m")), by, at, zero, add, add)
    return out.select(*by, at, *(F.col(f"state.{v}").alias(c) for c, v in fields.items()))
