"""Statistics of many slices of a series, as differences of running sums.

The ends of all slices of a series cut it into pieces. A row is summed up once, in its piece; sums run over the pieces
of a series, and a slice is the difference of two of them. Whatever the number of slices, no row is copied into them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions.lineage import cut
from . import screening as S

RANGE = ("train_lo", "train_hi", "test_lo", "test_hi")


def key_of(ranges: DataFrame) -> list[str]:
    """What names a slice: all columns but its ends."""
    return [c for c in ranges.columns if c not in RANGE]


def pieces(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """rows(symbol, pos), with `until`, the first of the ends(symbol, at) after each; rows after the last end go. pos has no gaps, from 0."""
    marks = ends.where("at > 0").distinct()
    before = F.coalesce(F.lag("at").over(Window.partitionBy("symbol").orderBy("at")), F.lit(0).cast("bigint"))
    places = marks.withColumn("__from", before).select("symbol", F.col("at").alias("until"), F.explode(F.sequence("__from", F.col("at") - 1)).alias("pos"))
    return rows.join(places, ["symbol", "pos"])


def upto(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """symbol, by, until, sums: over all rows of a series before each `until`; every piece has rows of every `by`."""
    each = rows.groupBy("symbol", *by, "until").agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in sums.items()))
    w = Window.partitionBy("symbol", *by).orderBy("until").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("symbol", *by, "until", *(F.sum(k).over(w).alias(k) for k in sums))


def between(running: DataFrame, slices: DataFrame, by: list[str], sums: dict[str, tuple[str, str]]) -> DataFrame:
    """The columns of slices, by, and each of sums = {name: (first, end)}: its sum over the rows from column `first` of a slice up to its `end`.

    Both are ends that the pieces of `running` were cut at, 0 or within the series.
    """
    columns = list(dict.fromkeys(c for pair in sums.values() for c in pair))
    sign = lambda c, name: F.lit(float((c == sums[name][1]) - (c == sums[name][0]))).alias(f"__{name}")
    marks = slices.select(*slices.columns, F.explode(F.array(*(F.struct(F.col(c).alias("until"), *(sign(c, k) for k in sums)) for c in columns))).alias("__m"))
    met = marks.select(*slices.columns, "__m.*").join(running, ["symbol", "until"])
    return met.groupBy(*slices.columns, *by).agg(*(F.sum(F.col(f"__{k}") * F.col(k)).alias(k) for k in sums))


def coefficients(rows: DataFrame, ranges: DataFrame, window: int) -> DataFrame:
    """key, i (from 0), ic: the |mean rank correlation| of each feature that varies in a slice, over the windows that the slice holds whole; 0 without any."""
    key = key_of(ranges)
    hi = F.col("train_hi")
    slices = ranges.select(*key, "train_lo", "train_hi", F.least(F.col("train_lo") + 1, hi).alias("__second"), F.least(F.col("train_lo") + (window - 1), hi).alias("__whole"))
    ends = slices.select("symbol", F.explode(F.array("train_hi", "__second", "__whole")).alias("at"))
    prior = F.lag("x").over(Window.partitionBy("symbol").orderBy("pos"))
    placed = pieces(rows.select("symbol", "pos", "x", "rho", prior.alias("prior")), ends)
    each = F.arrays_zip(F.col("x"), F.coalesce("rho", F.array().cast("array<double>")).alias("rho"), F.coalesce("prior", "x").alias("prior"))
    long = placed.select("symbol", "until", F.posexplode(each).alias("i", "v")).select("symbol", "until", "i", "v.x", "v.rho", "v.prior")
    # a feature varies in a slice if one of its rows after the first differs from the row before it
    running = upto(long, ["i"], {"changes": (F.col("x") != F.col("prior")).cast("double"), "windows": F.col("rho").isNotNull().cast("double"), "total": F.col("rho")})
    found = between(running, slices, ["i"], {"changes": ("__second", "train_hi"), "windows": ("__whole", "train_hi"), "total": ("__whole", "train_hi")})
    return found.where("changes > 0").select(*key, "i", F.abs(F.coalesce(C.div(F.col("total"), F.col("windows")), F.lit(0.0))).alias("ic"))


def correlations(rows: DataFrame, ranges: DataFrame, kept: DataFrame) -> DataFrame:
    """key, a, b, corr of the features that each slice has kept(key, feature, position from 1); NULL where a side does not vary.

    Sums of products, of the features that any slice of a series keeps, run over pieces; values are told from the series' first row.
    """
    key = key_of(ranges)
    slices = ranges.select(*key, "train_lo", "train_hi")
    ends = slices.select("symbol", F.explode(F.array("train_lo", "train_hi")).alias("at"))
    need = kept.groupBy("symbol").agg(F.array_sort(F.collect_set("position")).alias("need"))
    first = rows.where("pos = 0").select("symbol", F.col("x").alias("origin"))
    rows = pieces(rows.select("symbol", "pos", "x"), ends).join(need, "symbol").join(first, "symbol")
    v = rows.select("symbol", "until", F.expr("concat(array(1D), transform(need, p -> x[p - 1] - origin[p - 1]))").alias("v"))
    products = F.expr("flatten(transform(v, (a, i) -> transform(slice(v, i + 1, size(v)), b -> a * b)))")
    running = upto(v.select("symbol", "until", F.posexplode(products).alias("k", "s")), ["k"], {"s": F.col("s")})
    sums = between(running, slices, ["k"], {"s": ("train_lo", "train_hi")})
    table = sums.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("__s")).select(*key, F.col("__s.s").alias("__s"))
    placed = kept.select(*key, "feature", "position").join(need, "symbol").select(
        *key, "feature", (F.size("need") + 1).alias("m"), F.expr("cast(array_position(need, position) AS int)").alias("at")
    )
    pairs = placed.withColumnsRenamed({"feature": "a", "at": "i"}).join(placed.withColumnsRenamed({"feature": "b", "at": "j"}).drop("m"), key).where("i < j")
    of = lambda i, j: F.get("__s", (F.expr(f"{i} * m - {i} * ({i} - 1) div 2 + {j} - {i}")).cast("int"))
    d = pairs.join(table, key).select(
        *key, "a", "b", of("0", "0").alias("n"), of("0", "i").alias("si"), of("0", "j").alias("sj"),
        of("i", "i").alias("ii"), of("j", "j").alias("jj"), of("i", "j").alias("ij")
    )
    n = F.col("n")
    spread = lambda q, s: F.when(F.col(q) - F.col(s) * F.col(s) / n > 1e-12 * F.col(q), F.col(q) - F.col(s) * F.col(s) / n)
    return d.where("n > 0").select(*key, "a", "b", C.div(F.col("ij") - F.col("si") * F.col("sj") / n, F.sqrt(spread("ii", "si") * spread("jj", "sj"))).alias("corr"))


def screens(
    rows: DataFrame, ranges: DataFrame, features: list[str], groups: list[str], window: int = S.WINDOW, per_group: int = S.PER_GROUP,
    apart: float = S.CUT, cap: int = S.CAP
) -> DataFrame:
    """key, rank (from 1), feature, position (from 1), ic: the five steps of screening.screen() on each slice of ranges(key, train_lo, train_hi).

    rows(symbol, pos, x, rho) are as walkforward.prepared() gives them. A slice in which nothing varies has none.
    """
    key = key_of(ranges)
    ics = coefficients(rows, ranges, window).select(*key, F.get(F.array(*map(F.lit, features)), F.col("i")).alias("feature"), "ic")
    kept = cut(S.top_per_group(ics, dict(zip(features, groups)), per_group, tuple(key)).select(*key, "feature", "position", "ic"))
    left = S.one_of_each_cluster(kept, correlations(rows, ranges, kept), apart, tuple(key))
    order = Window.partitionBy(*key).orderBy(F.desc("ic"), "position")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select(*key, "rank", "feature", "position", "ic")
