"""Registration of queries, tables, and the inputs that the queries derive from the driver's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, bars, calendar

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 8


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives the same rows; double columns are rounded on both sides."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; sessions and closes are instants in UTC, whatever the host's zone is."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: list[DataFrame] = []


def once(df: DataFrame) -> DataFrame:
    """df, computed once for the query that asks for it; what an earlier query held is let go.

    A held table also ends the equalities that the optimiser keeps for each named expression: with 81 features
    these multiply at each join and filter above them.
    """
    while _held:
        _held.pop().unpersist()
    _held.append(df.persist())
    return df


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded; a negative zero becomes zero."""
    return df.select(*(((F.round(F.col(c), digits) + 0.0).alias(c)) if k == "double" else F.col(c) for c, k in df.dtypes))


def rnd(*names: str, digits: int = DIGITS) -> str:
    """SQL for the same."""
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.to_bars(table(spark, sf_dir, "orders"), F.lit("ALL"), F.to_date("o_orderdate"), "o_totalprice", "o_orderkey")


BARS = """
bars AS (
  SELECT 'ALL' AS symbol, CAST(o_orderdate AS DATE) AS session, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY 2)"""


def segment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(customers, "o_custkey")
    return bars.to_bars(rows, F.col("c_mktsegment"), F.to_date("o_orderdate"), "o_totalprice", "o_orderkey")


def symbols(spark: SparkSession, sf_dir: str) -> list[str]:
    """The panel's symbols (driver: one row each)."""
    return sorted(r["symbol"] for r in segment_bars(spark, sf_dir).select("symbol").distinct().collect())


PANEL = """
panel AS (
  SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS session, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.to_macro(table(spark, sf_dir, "lineitem"), F.to_date("l_shipdate"))


MACRO = """
macro AS (
  SELECT CAST(l_shipdate AS DATE) AS session,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS vix,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 1e4 AS dxy,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT) + l_linenumber) AS DOUBLE) / count(*) AS tnx,
    CAST(sum(l_suppkey % 100 + 1) AS DOUBLE) / count(*) AS oil,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS dgs3mo,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS dgs2,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS dgs10
  FROM lineitem GROUP BY 1)"""

MACRO_COLUMNS = ["vix", "dxy", "tnx", "oil", "dgs3mo", "dgs2", "dgs10"]
STYLES = {"qqq_close": "AUTOMOBILE", "iwm_close": "BUILDING", "dia_close": "FURNITURE"}


def snapshot(spark: SparkSession, sf_dir: str, market: bool = False) -> DataFrame:
    """The panel's bars (or those of the market as a whole) with macro series and three style closes, carried over gaps
    of up to five sessions; half-days by rule.
    """
    panel = segment_bars(spark, sf_dir)
    styles = panel.groupBy("session").agg(*(F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(c) for c, s in STYLES.items()))
    joined = align.left_align(align.left_align(market_bars(spark, sf_dir) if market else panel, macro(spark, sf_dir), ["session"]), styles, ["session"])
    joined = joined.withColumn("is_half_day", (F.dayofmonth("session") == 3).cast("int")).withColumn(
        "session_minutes", F.when(F.col("is_half_day") == 1, 210).otherwise(390)
    )
    return align.forward_fill(joined, [*MACRO_COLUMNS, *STYLES])


SNAPSHOT = f"""{PANEL},{MACRO},
styles AS (SELECT session, {", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {c}" for c, s in STYLES.items())} FROM panel GROUP BY 1),
snap AS (
  SELECT p.symbol, p.session, p.open, p.high, p.low, p.close, p.volume,
    {", ".join(f"last_value({c} IGNORE NULLS) OVER f AS {c}" for c in [*MACRO_COLUMNS, *STYLES])},
    CASE WHEN day(p.session) = 3 THEN 1 ELSE 0 END AS is_half_day, CASE WHEN day(p.session) = 3 THEN 210 ELSE 390 END AS session_minutes
  FROM panel p LEFT JOIN macro USING (session) LEFT JOIN styles USING (session)
  WINDOW f AS (PARTITION BY p.symbol ORDER BY p.session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""

MARKET = f"{BARS}," + SNAPSHOT.replace("FROM panel p LEFT", "FROM bars p LEFT")


def grid(spark: SparkSession, start: dt.date = dt.date(2024, 1, 1), end: dt.date = dt.date(2024, 1, 26)) -> DataFrame:
    """Sessions of January 2024, which end before the events do."""
    return calendar.sessions(spark, start, end)


GRID = """
grid AS (
  SELECT session, session + INTERVAL 14 HOUR + INTERVAL 30 MINUTE AS open_utc, session + INTERVAL 21 HOUR AS close_utc, 390 AS session_minutes, 0 AS is_half_day
  FROM (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-01-27', INTERVAL 1 DAY)) AS DATE) AS session)
  WHERE isodow(session) < 6 AND session NOT IN (DATE '2024-01-01', DATE '2024-01-15'))"""
