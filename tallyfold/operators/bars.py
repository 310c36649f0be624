"""Session bars from trade-like rows, and the macro series that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_bars(rows: DataFrame, symbol: Column, session: Column, price: str, order: str) -> DataFrame:
    """symbol, session, open, high, low, close, volume: first, highest, lowest and last price by `order`, and the number of rows."""
    return rows.groupBy(symbol.alias("symbol"), session.alias("session")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("volume")
    )


def _mean(total: Column, scale: float = 1.0) -> Column:
    return total.cast("double") / F.count(F.lit(1)) / scale


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def to_macro(rows: DataFrame, session: Column) -> DataFrame:
    """Daily rate-like and index-like series; sums are of integers, so that the order of rows does not matter."""
    return rows.groupBy(session.alias("session")).agg(
        _mean(F.sum(F.col("l_quantity").cast("long"))).alias("vix"),
        _mean(F.sum(_cents("l_extendedprice")), 1e4).alias("dxy"),
        _mean(F.sum(_cents("l_tax") + F.col("l_linenumber"))).alias("tnx"),
        _mean(F.sum(F.col("l_suppkey") % 100 + 1)).alias("oil"),
        _mean(F.sum(_cents("l_discount"))).alias("dgs3mo"),
        _mean(F.sum(_cents("l_tax"))).alias("dgs2"),
        _mean(F.sum(_cents("l_discount") + _cents("l_tax"))).alias("dgs10"),
    )
