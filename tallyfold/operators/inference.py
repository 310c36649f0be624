"""Bootstrap inference as relational algebra, and parametric cross-checks.

Index paths come from a hash of (seed, replicate, position), so they are the same everywhere, need no
state and are partitioned by replicate. All statistics of one replicate share a path, which is what makes
a comparison of two series paired.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions.scan import running_sums

BLOCK, REPLICATES, SEED = 20.0, 10_000, 20260823


def _digest(seed: int, tag: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), F.col("rep").cast("string"), F.col("i").cast("string")))


def uniform_hash(seed: int, tag: str) -> Column:
    """A 32-bit number from seed, tag, rep and i."""
    return F.conv(F.substring(_digest(seed, tag), 1, 8), 16, 10).cast("long")


def chance(seed: int, tag: str, p: float) -> Column:
    """Whether the number is below p of 2^32, told from the digest's digits."""
    return F.lit(True) if p >= 1 else _digest(seed, tag) < f"{math.ceil(p * (1 << 32)):08x}"


def segments(spark: SparkSession, n: int, replicates: int = REPLICATES, block: float = BLOCK, seed: int = SEED) -> DataFrame:
    """rep, at, start, length: the stationary bootstrap as segments of consecutive rows, round the end of the series.

    Place i of a path starts a segment with probability 1/block, at a uniform row; a path has n places.
    """
    grid = spark.range(replicates * n).select(F.expr(f"id div {n}").alias("rep"), (F.col("id") % n).alias("i"))
    begun = grid.where((F.col("i") == 0) | chance(seed, "r", 1.0 / block))
    until = F.coalesce(F.lead("i").over(Window.partitionBy("rep").orderBy("i")), F.lit(n))
    return begun.select("rep", F.col("i").alias("at"), (uniform_hash(seed, "s") % n).alias("start"), (until - F.col("i")).alias("length"))


def moments(*names: str) -> dict[str, Column]:
    """Columns whose sums over any rows give the statistics of the named series; with two names, of their common rows as well."""
    out: dict[str, Column] = {}
    for x in names:
        out |= {f"n_{x}": F.col(x).isNotNull().cast("double"), f"s_{x}": F.col(x), f"q_{x}": F.col(x) * F.col(x)}
    if len(names) == 2:
        y, x = names
        both = F.col(y).isNotNull() & F.col(x).isNotNull()
        masked = {"n": F.lit(1.0), "y": F.col(y), "x": F.col(x), "xy": F.col(y) * F.col(x), "xx": F.col(x) * F.col(x)}
        out |= {f"{k}_{y}_{x}": F.when(both, v) for k, v in masked.items()}
    return out


def _mean_sd(x: str) -> tuple[Column, Column]:
    n, s, q = F.col(f"n_{x}"), F.col(f"s_{x}"), F.col(f"q_{x}")
    spread = q - s * C.div(s, n)
    # what rounding leaves of a constant is no variation
    return C.div(s, n), F.sqrt(F.when((n > 1) & (spread > 1e-12 * q), C.div(spread, n - 1)))


def moment_sharpe(x: str) -> Column:
    """Annualised mean over deviation, of the sums of moments(x)."""
    mean, sd = _mean_sd(x)
    return C.div(mean, sd) * F.sqrt(F.lit(float(C.TRADING_DAYS)))


def moment_mean(x: str, scale: float = 1.0) -> Column:
    return scale * C.div(F.col(f"s_{x}"), F.col(f"n_{x}"))


def moment_slope(y: str, x: str) -> Column:
    """Least-squares slope, of the sums of moments(y, x)."""
    of = lambda k: F.col(f"{k}_{y}_{x}")
    below = of("xx") - of("x") * C.div(of("x"), of("n"))
    return C.div(of("xy") - of("x") * C.div(of("y"), of("n")), F.when(below > 1e-12 * of("xx"), below))


def draws(
    series: DataFrame, n: int, sums: dict[str, Column], statistics: dict[str, Column], replicates: int = REPLICATES, block: float = BLOCK,
    seed: int = SEED, by: list[str] = []
) -> DataFrame:
    """by, rep and the statistics (of the sums) of each replicate; a series (by) has a row for each idx from 0 to n - 1.

    A segment's sums are the difference of two running sums, and one that passes the end is two segments; so a replicate
    costs as many rows as it has segment ends, not as many as it has places. All statistics of a replicate, and all series, share its path.
    """
    rows = series.select(*by, "idx", *(v.alias(k) for k, v in sums.items()))
    upto = running_sums(rows, by, "idx", list(sums)).withColumn("idx", F.col("idx") + 1)
    end = F.col("start") + F.col("length")
    ends = F.array(
        F.struct(F.col("start").alias("idx"), F.lit(-1.0).alias("sign")), F.struct(F.least(end, F.lit(n)).alias("idx"), F.lit(1.0).alias("sign")),
        F.struct(F.greatest(end - n, F.lit(0)).alias("idx"), F.lit(1.0).alias("sign"))
    )
    cuts = segments(series.sparkSession, n, replicates, block, seed).select("rep", F.explode(ends).alias("e")).select("rep", "e.idx", "e.sign").where("idx > 0")
    whole = cuts.join(upto, "idx").groupBy(*by, "rep").agg(*(F.sum(F.col("sign") * F.col(k)).alias(k) for k in sums))
    return whole.select(*by, "rep", *(v.alias(k) for k, v in statistics.items()))


def interval(drawn: DataFrame, name: str, point: DataFrame | None = None) -> DataFrame:
    """lo, hi (95% percentiles), se and fraction_nonpositive of a drawn statistic, beside its point value."""
    out = drawn.agg(
        F.percentile(name, F.lit(0.025)).alias("lo"), F.percentile(name, F.lit(0.975)).alias("hi"),
        F.stddev_samp(name).alias("se"), F.avg((F.col(name) <= 0).cast("double")).alias("fraction_nonpositive")
    )
    return out if point is None else point.crossJoin(out)  # one row each


def indexed(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """idx from 0 in session order (of one series, or of each key)."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(*(by or [])).orderBy("session")).cast("long") - 1)


def autocovariances(series: DataFrame, x: str, by: list[str], lags: int, session: str = "session") -> DataFrame:
    """by, n, lag, cov: the sum of (x_i - mean)(x_(i + lag) - mean) over n, for each lag from 0 to `lags` that the series has.

    A row has its lagged values as an array; all lags of all series are one aggregate, which tasks sum up before the shuffle.
    Rows where x is NULL take no part.
    """
    w = Window.partitionBy(*by)
    d = series.select(*by, session, F.col(x).cast("double").alias("__x")).where("__x IS NOT NULL")
    d = d.select(*by, session, (F.col("__x") - F.avg("__x").over(w)).alias("__d"), F.count(F.lit(1)).over(w).alias("n"))
    back = F.collect_list("__d").over(w.orderBy(session).rowsBetween(-lags, 0))
    pairs = d.select(*by, "n", "__d", back.alias("__back")).select(*by, "n", "__d", F.posexplode(F.reverse("__back")).alias("lag", "__e"))
    return pairs.groupBy(*by, "n", "lag").agg((F.sum(F.col("__d") * F.col("__e")) / F.col("n")).alias("cov"))


def block_lengths(series: DataFrame, x: str, by: list[str], session: str = "session") -> DataFrame:
    """by, block: block length for the stationary bootstrap by the flat-top lag window, with the published correction.

    1 for fewer than 8 values and for a constant. The longest series (one number, read by the driver) says how many lags a row keeps.
    """
    longest = series.groupBy(*by).agg(F.count(x).alias("n")).agg(F.max("n")).first()[0] or 0
    run = max(5, math.ceil(math.log10(max(longest, 1))))
    cov = autocovariances(series, x, by, math.ceil(math.sqrt(longest)) + 2 * run, session)
    one = cov.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "cov"))), lambda c: c["cov"]).alias("all"))
    one = one.withColumn("run", F.greatest(F.lit(5), F.ceil(F.log10("n")).cast("int")))
    one = one.withColumn("most", F.ceil(F.sqrt("n")).cast("int") + F.col("run"))
    one = one.withColumn("c", F.expr("slice(all, 1, least(most + run, n - 1) + 1)"))
    one = one.withColumn("small", F.expr("transform(slice(c, 2, size(c)), v -> abs(v) < 2 * sqrt(log10(n) / n) * c[0])"))
    quiet = "filter(sequence(0, size(small) - run), i -> forall(slice(small, i + 1, run), v -> v))"
    large = "filter(sequence(1, size(small)), i -> NOT small[i - 1])"
    known = (F.col("n") >= 8) & (F.try_element_at("c", F.lit(1)) > 0)
    one = one.withColumn("m", F.when(known, F.expr(f"coalesce(get({quiet}, 0), array_max({large}), 1)")))
    one = one.withColumn("top", F.expr("least(2 * greatest(m, 1), most, size(c) - 1)"))
    weighted = "aggregate(sequence(1, top), 0D, (s, k) -> s + least(greatest(2 * (1 - k / top), 0), 1) * {} c[k])"
    one = one.withColumns({"g": F.when(known, 2 * F.expr(weighted.format("k *"))), "s": F.when(known, F.expr("c[0]") + 2 * F.expr(weighted.format("")))})
    best = F.expr("power(g * g / nullif(s * s, 0), 1D / 3) * power(n, 1D / 3)")
    bounded = F.least(F.greatest(best, F.lit(1.0)), F.expr("ceil(least(3 * sqrt(n), n / 3))").cast("double"))
    return one.select(*by, F.when(F.col("s") != 0, bounded).otherwise(1.0).alias("block"))


def jobson_korkie(a: str, b: str) -> list[Column]:
    """Memmel's z for the difference of two Sharpe ratios, in session units, and their correlation."""
    sa, sb = F.avg(a) / F.stddev_samp(a), F.avg(b) / F.stddev_samp(b)
    rho = C.correlation(a, b)
    var = (2 - 2 * rho + 0.5 * (sa * sa + sb * sb - 2 * sa * sb * rho * rho)) / F.count(F.lit(1))
    return [rho.alias("rho"), F.when(var > 0, (sa - sb) / F.sqrt(F.when(var > 0, var))).alias("z")]


def two_sided_p(z: Column | str) -> Column:
    """Two-sided normal p-value; there is no normal distribution function in SQL."""

    @F.pandas_udf("double")
    def p(values):
        return values.map(lambda v: None if v != v else math.erfc(abs(v) / math.sqrt(2)))

    return p(z)


def expected_max_sharpe(n_trials: int, sd: float) -> float:
    """Expected highest Sharpe ratio among so many unrelated strategies of no skill."""
    if n_trials < 2:
        return 0.0
    gamma, inv = 0.5772156649015329, NormalDist().inv_cdf
    return sd * ((1 - gamma) * inv(1 - 1 / n_trials) + gamma * inv(1 - 1 / (n_trials * math.e)))


def slope(y: str, x: str) -> Column:
    """Least-squares slope; NULL without variation of x."""
    return C.div(F.covar_samp(y, x), F.var_samp(x))
