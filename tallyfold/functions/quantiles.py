"""Quantiles of all rows of a series up to a row, by cumulative counts.

The values of a series are ranked once. Ranks and places are cut into blocks of about the root of the series' length,
and counts by (block of places, block of ranks), summed up along places and then along ranks, say which ranks the
quantiles of one block of places can have: its own rows move an order statistic by no more places than there are
of them. So a block of places meets its own rows and one band of earlier values, a few times its size, and each
block is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_BLOCK = 64


def prefix_quantiles(rows: DataFrame, by: list[str], at: str, x: str, qs: list[float], wanted: Column | None = None) -> DataFrame:
    """by, at, q, n, value: the interpolated q-quantile of the n values of x at places up to `at`, for rows with a value.

    Places are distinct within a series and x is never NaN; rows where x is NULL take no part. `wanted`, a condition on
    at, n and __all (the number of values of the series), leaves out rows whose quantile nobody asks for.
    """
    w = Window.partitionBy(*by)
    size = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt(F.col("__all"))).cast("bigint"))
    v = rows.select(*by, F.col(at).alias("__at"), F.col(x).cast("double").alias("__x")).where("__x IS NOT NULL")
    v = v.select(
        *by, "__at", "__x", (F.row_number().over(w.orderBy("__at")).cast("bigint") - 1).alias("__j"),
        (F.row_number().over(w.orderBy("__x", "__at")).cast("bigint") - 1).alias("__rank"), F.count(F.lit(1)).over(w).alias("__all")
    ).withColumn("__size", size).select(
        *by, "__at", "__x", "__j", "__all", "__size", F.expr("__j div __size").alias("__block"), F.expr("__rank div __size").alias("__bucket")
    )
    # as many buckets as blocks, each at most the root of the series: the table has no more rows than the series
    counted = v.groupBy(*by, "__size", "__all", "__bucket", "__block").agg(F.count(F.lit(1)).alias("__n"))
    of_bucket = counted.groupBy(*by, "__size", "__all", "__bucket").agg(F.map_from_entries(F.collect_list(F.struct("__block", "__n"))).alias("__counts"))
    dense = of_bucket.select(*by, "__size", "__bucket", "__counts", F.expr("explode(sequence(0L, (__all - 1) div __size))").alias("__block"))
    dense = dense.withColumn("__n", F.coalesce(F.expr("try_element_at(__counts, __block)"), F.lit(0)))
    before = Window.unboundedPreceding, -1
    dense = dense.withColumn("__seen", F.coalesce(F.sum("__n").over(Window.partitionBy(*by, "__bucket").orderBy("__block").rowsBetween(*before)), F.lit(0)))
    dense = dense.withColumn("__below", F.coalesce(F.sum("__seen").over(Window.partitionBy(*by, "__block").orderBy("__bucket").rowsBetween(*before)), F.lit(0)))
    q, first = F.col("q"), F.col("__block") * F.col("__size")
    low = F.floor(q * first) - F.col("__size")
    high = F.floor(q * (first + F.col("__size") - 1)) + 1
    chosen = dense.where("__seen > 0").withColumn("q", F.explode(F.array(*map(F.lit, qs)))).where(
        (F.col("__below") <= high) & (F.col("__below") + F.col("__seen") > low)
    ).select(*by, "__block", "__bucket", "q", "__below")
    earlier = v.select(*by, "__bucket", "__x", F.col("__block").alias("__of"))
    bands = chosen.join(earlier, [*by, "__bucket"]).where("__of < __block").groupBy(*by, "__block", "q").agg(
        F.collect_list("__x").alias("__band"), F.min("__below").alias("__base")
    )
    own = v.groupBy(*by, "__block", "__all").agg(F.array_sort(F.collect_list(F.struct("__j", "__at", "__x"))).alias("__own"))
    own = own.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    met = own.join(bands, [*by, "__block", "q"], "left")
    each = met.select("*", F.posexplode("__own").alias("__i", "__row")).select(
        *by, F.col("__row.__at").alias(at), "q", (F.col("__row.__j") + 1).alias("n"), "__all", "__i", "__own", "__band", "__base"
    )
    if wanted is not None:
        each = each.where(wanted)
    until = F.expr("transform(slice(__own, 1, __i + 1), r -> r.__x)")
    known = F.array_sort(F.concat(F.coalesce("__band", F.array().cast("array<double>")), until))
    place = F.col("q") * (F.col("n") - 1)
    k = (F.floor(place) - F.coalesce("__base", F.lit(0))).cast("int")
    each = each.select(*by, at, "q", "n", known.alias("__known"), k.alias("__k"), (place - F.floor(place)).alias("__part"))
    a, b = F.get("__known", F.col("__k")), F.get("__known", F.col("__k") + 1)
    return each.select(*by, at, "q", "n", F.when(F.col("__part") > 0, a + (b - a) * F.col("__part")).otherwise(a).alias("value"))


def expanding_quantiles(
    df: DataFrame, outputs: dict[str, tuple[str, float, int]], symbol: str = "symbol", session: str = "session"
) -> DataFrame:
    """Adds each output = (input, q, least): the interpolated q-quantile of all values up to a row, NULL below `least` of them.

    A session is in a series once. NaN counts as missing; a row without a value has the quantile of those before it.
    """
    out = df
    for name, (source, q, least) in outputs.items():
        x = F.col(source).cast("double")
        rows = df.select(symbol, session, F.when(~F.isnan(x), x).alias("__v"))
        found = prefix_quantiles(rows, [symbol], session, "__v", [q], F.col("n") >= max(least, 1)).select(symbol, session, F.col("value").alias("__q"))
        upto = Window.partitionBy(symbol).orderBy(session)
        out = out.join(found, [symbol, session], "left").withColumn(name, F.last("__q", ignorenulls=True).over(upto)).drop("__q")
    return out.select(*df.columns, *outputs)
