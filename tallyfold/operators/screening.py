"""Feature screening: rolling rank correlation, top of each group, correlation clusters, cap.

Rank correlations run over ranges of a series, correlations are mergeable co-moments; only the few features of a series
that are left meet for the clustering. slices.screens() screens the slices of a walk.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as C

WINDOW, PER_GROUP, CUT, CAP = 60, 3, 0.20, 25
#: Rows of a series that are ranked together, beside those that their windows reach back to.
RANGE = 128


def unpivot(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep, feature, x: a row for each feature that is not missing."""
    wide = df.select(*keep, F.array(*(F.col(f).cast("double") for f in features)).alias("__x"))
    long = wide.select(*keep, F.posexplode("__x").alias("__i", "x"))
    return long.select(*keep, F.get(F.array(*map(F.lit, features)), F.col("__i")).alias("feature"), "x").where("x IS NOT NULL")


def centred_ranks(v: np.ndarray, window: int) -> np.ndarray:
    """For each window of v its values' ranks, averaged over ties, less their mean."""
    w = np.lib.stride_tricks.sliding_window_view(v, window)
    order = np.argsort(w, 1)
    tie = np.diff(np.take_along_axis(w, order, 1)) == 0
    places = np.broadcast_to(np.arange(window, dtype=float), w.shape)
    if tie.any():
        first = np.maximum.accumulate(np.where(np.c_[np.zeros(len(w), bool), tie], 0, places), 1)
        last = np.minimum.accumulate(np.where(np.c_[tie, np.zeros(len(w), bool)], window, places)[:, ::-1], 1)[:, ::-1]
        places = (first + last) / 2
    out = np.empty(w.shape)
    np.put_along_axis(out, order, places - (window - 1) / 2, 1)
    return out


def rolling_spearman(long: DataFrame, window: int = WINDOW, by: tuple[str, ...] = ("symbol", "feature"), block: int = RANGE) -> DataFrame:
    """by, pos, rho: rank correlation of x and z over the last `window` rows, ranks averaged over ties within the window; a row for each whole window.

    NULL where a side has one value only. long: by, pos, x, z, without missing values; each key is a series, and pos its
    places without gaps. A series is cut into ranges of `block` rows, each with the window - 1 rows before it, and a range
    is ranked on its own: no group is larger, however long the series.
    """
    rows = long.select(*by, F.col("pos").cast("bigint").alias("pos"), (F.col("x") + 0.0).alias("x"), (F.col("z") + 0.0).alias("z"))
    spread = rows.withColumn("__range", F.explode(F.expr(f"sequence(pos div {block}, (pos + {window - 1}) div {block})")))
    ranges = spread.groupBy(*by, "__range").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "z"))).alias("__rows"))

    @F.pandas_udf("array<double>")
    def correlations(xs: pd.Series, zs: pd.Series) -> pd.Series:
        def of(x, z):
            if len(x) < window:
                return np.zeros(0)
            rx, rz = centred_ranks(x, window), centred_ranks(z, window)
            below = np.sqrt((rx * rx).sum(1) * (rz * rz).sum(1))
            return np.divide((rx * rz).sum(1), below, out=np.full(len(rx), np.nan), where=below > 0)

        return pd.Series([of(x, z) for x, z in zip(xs, zs)])

    found = ranges.select(*by, "__range", F.col("__rows.pos").alias("__pos"), correlations("__rows.x", "__rows.z").alias("__rho"))
    ends = F.arrays_zip(F.slice("__pos", F.lit(window), F.greatest(F.size("__pos") - (window - 1), F.lit(0))).alias("pos"), F.col("__rho").alias("rho"))
    out = found.select(*by, "__range", F.explode(ends).alias("__y")).where(F.col("__y.pos") >= F.col("__range") * block)
    return out.select(*by, "__y.pos", C.no_nan(F.col("__y.rho")).alias("rho"))


def rolling_spearman_all(df: DataFrame, features: list[str], window: int = WINDOW) -> DataFrame:
    """symbol, feature, pos, rho of all features of df(symbol, pos, z, features), without missing values."""
    return rolling_spearman(unpivot(df, features, ["symbol", "pos", "z"]), window)


def information_coefficients(rho: DataFrame, by: tuple[str, ...] = ("symbol", "feature")) -> DataFrame:
    """|mean rank correlation|; 0 where no window has one."""
    return rho.groupBy(*by).agg(F.coalesce(F.abs(F.avg("rho")), F.lit(0.0)).alias("ic"))


def varying(long: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """by, feature of the features with more than one value, of long(by, feature, x)."""
    return long.groupBy(*by, "feature").agg((F.min("x") < F.max("x")).alias("__varies")).where("__varies").drop("__varies")


def top_per_group(ics: DataFrame, groups: dict[str, str], k: int = PER_GROUP, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The k highest ic of each feature group, with feature_group and rank_in_group; ties by the order of `groups`
    (feature -> group), which is metadata and part of the plan.
    """
    names, of = F.array(*map(F.lit, groups)), F.array(*map(F.lit, groups.values()))
    placed = ics.withColumn("position", F.array_position(names, F.col("feature")).cast("int")).where("position > 0")
    placed = placed.withColumn("feature_group", F.element_at(of, F.col("position")))
    w = Window.partitionBy(*by, "feature_group").orderBy(F.desc("ic"), "position")
    return placed.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= k)


def co_moments(x: np.ndarray) -> np.ndarray:
    """Of rows x (nan: missing), for each pair of columns i, j over the rows that have both: how many, mean and squares of i, products."""
    h = ~np.isnan(x)
    centre = np.where(h, x, 0).sum(0) / np.maximum(h.sum(0), 1)
    x, h = np.where(h, x - centre, 0.0), h.astype(float)
    n = h.T @ h
    mean = np.divide(x.T @ h, n, out=np.zeros(n.shape), where=n > 0)
    return np.stack([n, mean + centre[:, None], (x * x).T @ h - n * mean * mean, x.T @ x - n * mean * mean.T])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The co-moments of the rows of both."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros(n.shape), where=n > 0)
    apart = np.where(a[0] > 0, b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + apart * share, b[1])
    return np.stack([n, mean, a[2] + b[2] + apart * apart * a[0] * share, a[3] + b[3] + apart * apart.T * a[0] * share])


def correlation_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """symbol, a, b, corr for each pair of features of a series, over the rows that have both; NULL where a side does not vary.

    Each task sums up its rows of a series as co-moments, whose size is that of the pairs; these merge, so no series is
    in one task and no row leaves its own.
    """
    rows, k = df.select("symbol", F.array(*(F.col(f).cast("double") for f in features)).alias("x")), len(features)

    def note(batches):
        held: dict[str | None, np.ndarray] = {}
        for b in batches:
            pdf = b.to_pandas()
            for symbol, part in pdf.groupby("symbol", dropna=False):
                found = co_moments(np.array(part["x"].tolist(), float).reshape(len(part), k))
                held[symbol] = merged(held[symbol], found) if symbol in held else found
        yield pa.RecordBatch.from_pylist([{"symbol": s, "m": m.tobytes()} for s, m in held.items()], pa.schema([("symbol", pa.string()), ("m", pa.binary())]))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, _, squares, products = reduce(merged, (np.frombuffer(m).reshape(4, k, k) for m in pdf["m"]))
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = products / np.sqrt(squares * squares.T)
        a, b = np.triu_indices(k, 1)
        return pd.DataFrame({"symbol": key[0], "a": np.array(features)[a], "b": np.array(features)[b], "corr": corr[a, b]})

    pairs = rows.mapInArrow(note, "symbol string, m binary").groupBy("symbol").applyInPandas(meet, "symbol string, a string, b string, corr double")
    names = unpivot(df, features, ["symbol"])
    moving = varying(names).select("symbol", "feature")
    both = pairs.join(moving.toDF("symbol", "a").withColumn("va", F.lit(True)), ["symbol", "a"], "left").join(moving.toDF("symbol", "b").withColumn("vb", F.lit(True)), ["symbol", "b"], "left")
    return both.select("symbol", "a", "b", F.when(F.col("va") & F.col("vb") & ~F.isnan("corr"), F.col("corr")).alias("corr"))


def average_linkage(distance: np.ndarray, cut: float) -> list[int]:
    """Cluster numbers: the closest two clusters, by mean distance of their members, are merged while that is at most cut."""
    n = len(distance)
    d, size, of = distance.astype(float).copy(), np.ones(n), np.arange(n)
    np.fill_diagonal(d, np.inf)
    while n and np.isfinite(best := d.min()) and best <= cut:
        i, j = sorted(divmod(int(d.argmin()), n))
        d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[:, i] = d[i]
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
        of[of == j] = i
    return np.unique(of, return_inverse=True)[1].tolist() if n else []


def one_of_each_cluster(kept: DataFrame, pairs: DataFrame, cut: float = CUT, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """kept(by, feature, ic, position) without those that cluster, by 1 - |corr|, with one of higher ic.

    What comes together is a series' kept features, PER_GROUP a group, and their pairs.
    """
    both = kept.select(*by, F.col("feature").alias("a"), F.col("position").alias("i")).join(pairs, [*by, "a"])
    both = both.join(kept.select(*by, F.col("feature").alias("b"), F.col("position").alias("j")), [*by, "b"])
    edges = both.groupBy(*by).agg(F.collect_list(F.struct("i", "j", F.coalesce(F.abs("corr"), F.lit(0.0)).alias("r"))).alias("pairs"))
    nodes = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("ic")).alias("order"), "position", "feature", "ic"))).alias("nodes"))

    @F.pandas_udf("array<int>")
    def clusters(nodes: pd.Series, pairs: pd.Series) -> pd.Series:
        def of(ns, ps):
            places = {p: k for k, p in enumerate(sorted(n["position"] for n in ns))}
            d = np.ones((len(places), len(places)))
            for p in ps if ps is not None else ():
                i, j = places[p["i"]], places[p["j"]]
                d[i, j] = d[j, i] = max(1 - p["r"], 0.0)
            found = average_linkage(d, cut)
            return [found[places[n["position"]]] for n in ns]

        return pd.Series([of(n, p) for n, p in zip(nodes, pairs)])

    placed = nodes.join(edges, list(by), "left").withColumn("of", clusters("nodes", "pairs"))
    best = "filter(nodes, (n, k) -> array_position(of, of[k]) = k + 1)"
    return placed.select(*by, F.explode(F.expr(best)).alias("n")).select(*by, "n.feature", "n.ic", "n.position")


def screen(
    df: DataFrame, features: list[str], groups: dict[str, str], window: int = WINDOW, per_group: int = PER_GROUP,
    cut: float = CUT, cap: int = CAP
) -> DataFrame:
    """symbol, rank (from 1), feature, ic: the five steps on each whole series of df(symbol, pos, z, features), without missing values:
    features that vary, |mean rank correlation|, the best of each group, one of each cluster, at most cap.
    """
    long = unpivot(df, features, ["symbol", "pos", "z"])
    ics = information_coefficients(rolling_spearman(long, window))
    # series that are shorter than a window have features, all of ic 0
    alive = varying(long).join(ics, ["symbol", "feature"], "left").withColumn("ic", F.coalesce("ic", F.lit(0.0)))
    kept = top_per_group(alive, {f: groups[f] for f in features}, per_group)
    left = one_of_each_cluster(kept, correlation_pairs(df, features), cut)
    order = Window.partitionBy("symbol").orderBy(F.desc("ic"), "position")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("symbol", "rank", "feature", "ic")
