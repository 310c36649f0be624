"""Alignment of series, events and dates with a grid of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import series

#: rows of a table that may be sent to all executors
SMALL = 100_000


def small(table: DataFrame, rows: int) -> DataFrame:
    """The table, to be broadcast if it has no more rows than SMALL; else Spark chooses."""
    return F.broadcast(table) if rows <= SMALL else table


def left_align(spine: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """All rows of the spine with the source's columns where it has the same key."""
    return spine.join(source, on, "left")


def carried(x: str, limit: int) -> Column:
    """x, or its last value at most `limit` rows before."""
    return F.last(x, ignorenulls=True).over(series().rowsBetween(-limit, 0))


def forward_fill(df: DataFrame, columns: list[str], limit: int = 5) -> DataFrame:
    """Each column carried over gaps; where a gap is longer than `limit` rows its first `limit` rows are filled."""
    return df.select(*(carried(c, limit).alias(c) if c in columns else F.col(c) for c in df.columns))


def fill_coverage(df: DataFrame, columns: list[str], limit: int = 5) -> DataFrame:
    """series_name, n_native, n_missing, n_filled, n_unresolved: one row for each column and symbol."""
    filled = df.select("symbol", *(F.col(c) for c in columns), *(carried(c, limit).alias(f"{c}__f") for c in columns))
    long = filled.select(
        "symbol",
        F.inline(
            F.array(
                *(F.struct(F.lit(c).alias("series_name"), F.col(c).cast("double").alias("raw"), F.col(f"{c}__f").cast("double").alias("full")) for c in columns)
            )
        )
    )
    return long.groupBy("symbol", "series_name").agg(
        F.count("raw").alias("n_native"), F.count_if(F.col("raw").isNull()).alias("n_missing"),
        (F.count("full") - F.count("raw")).alias("n_filled"), F.count_if(F.col("full").isNull()).alias("n_unresolved"),
    )


def trim_leading(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each symbol from its first one in which no column is missing."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    w = Window.partitionBy("symbol")
    return df.withColumn("__first", F.min(F.when(whole, F.col("session"))).over(w)).where(F.col("session") >= F.col("__first")).drop("__first")


def interior_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """symbol, n_gaps: rows after trim_leading in which a column is still missing."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return trim_leading(df, columns).groupBy("symbol").agg(F.count_if(missing).alias("n_gaps"))


def closed_spine(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each symbol from its first to its last one in which no column is missing; a gap between them raises, naming symbols."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    w = Window.partitionBy("symbol")
    capped = trim_leading(df, columns).withColumn(
        "__last", F.max(F.when(whole, F.col("session"))).over(w)
    ).where(F.col("session") <= F.col("__last")).drop("__last")
    gaps = interior_gaps(capped, columns).where("n_gaps > 0").orderBy("symbol").limit(10).collect()
    if gaps:
        raise ValueError(f"gaps inside the spine: {[(r['symbol'], r['n_gaps']) for r in gaps]}")
    return capped


def asof_bucket(events: DataFrame, grid: DataFrame, ts: str, at: str = "close_utc", session: str = "session") -> DataFrame:
    """The first session of the grid that closes at or after the event: left-open, right-closed buckets; NULL after the last.

    A table with a row for each day of the grid's span has the day's closes and the first session after that
    day. Events look their day up in it, so they are not shuffled, sorted or compared with other days, unless the grid
    has more than SMALL days and closes.
    """
    closes = grid.select(F.to_date(at).alias("__day"), F.col(at).alias("__at"), F.col(session).alias("__session"))
    by_day = closes.groupBy("__day").agg(F.array_sort(F.collect_list(F.struct("__at", "__session"))).alias("__closes"))
    first, last, size = closes.agg(F.min("__day"), F.max("__day"), F.count(F.lit(1))).first()
    events = events.withColumn("__day", F.to_date(ts))
    if last is None:
        return events.withColumn(session, F.lit(None).cast("date")).drop("__day")
    days = grid.sparkSession.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS __day")
    later = Window.orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)
    table = days.join(by_day, "__day", "left").withColumn("__next", F.last(F.col("__closes")[0]["__session"], ignorenulls=True).over(later))
    own = F.filter("__closes", lambda c: c["__at"] >= F.col(ts))
    before = F.lit(first).cast("date")
    joined = events.withColumn("__key", F.greatest(F.col("__day"), before)).join(
        small(table.withColumnRenamed("__day", "__key"), (last - first).days + size), "__key", "left"
    )  # one row a day of the grid
    hit = F.coalesce(F.get(own, F.lit(0))["__session"], F.col("__next"))
    return joined.withColumn(session, F.when(F.col(ts).isNotNull(), hit)).drop("__day", "__key", "__closes", "__next")


def asof_by(
    events: DataFrame, grid: DataFrame, ts: str, by: list[str], at: str = "close_utc", session: str = "session", unit: str = "day"
) -> DataFrame:
    """As asof_bucket with a grid for each key (by): the first session of the event's key that closes at or after the event.

    Time is cut into cells of one unit. The closes of a cell are an array, and the first one after a cell is carried back over the
    cells of its key; so events are never sorted, and a key's events meet only its cells, in a join by (key, cell) that Spark
    may split where one is hot. Of closes at one instant the smallest session counts. NULL after the last close, for
    events without a time, and for keys that the grid does not have.
    """
    when, key = F.date_trunc(unit, F.col(ts)), [*by, "__cell"]
    closes = grid.where(F.col(at).isNotNull()).select(
        *by, F.date_trunc(unit, F.col(at)).alias("__cell"), F.struct(F.col(at).alias("__at"), F.col(session).alias("__session")).alias("__close")
    )
    of_cell = closes.groupBy(*key).agg(F.array_sort(F.collect_list("__close")).alias("__closes"))
    met = events.select(*by, when.alias("__cell")).where("__cell IS NOT NULL").distinct().join(of_cell.select(*key, F.lit(1).alias("__own")), key, "left_anti")
    cells = of_cell.unionByName(met, allowMissingColumns=True)
    later = Window.partitionBy(*by).orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    table = cells.withColumn("__next", F.last(F.get("__closes", F.lit(0))["__session"], ignorenulls=True).over(later))
    joined = events.withColumn("__cell", when).join(table, key, "left")
    own = F.filter("__closes", lambda c: c["__at"] >= F.col(ts))
    found = joined.withColumn("__found", F.coalesce(F.get(own, F.lit(0))["__session"], F.col("__next")))
    return found.select(*(F.col(c) for c in events.columns if c != session), F.col("__found").alias(session))


def roll_forward(dates: DataFrame, grid: DataFrame, on: str, session: str = "session") -> DataFrame:
    """The first session at or after a date, NULL after the last. The table of days is as long as the grid's span."""
    bounds = grid.agg(F.min(session), F.max(session)).first()
    if bounds[0] is None:
        return dates.withColumn(session, F.lit(None).cast("date"))
    days = grid.sparkSession.sql(f"SELECT explode(sequence(date'{bounds[0]}', date'{bounds[1]}')) AS __day")
    w = Window.orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, 0)
    marks = grid.select(F.col(session).alias("__s")).distinct()
    table = days.join(marks, F.col("__day") == F.col("__s"), "left").select("__day", F.last("__s", ignorenulls=True).over(w).alias(session))
    key = F.greatest(F.col(on), F.lit(bounds[0]).cast("date"))
    return dates.withColumn("__key", key).join(
        small(table.withColumnRenamed("__day", "__key"), (bounds[1] - bounds[0]).days + 1), "__key", "left"
    ).drop("__key")  # one row a day: 36,525 a century


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the first in order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def same_index(a: DataFrame, b: DataFrame, on: list[str]) -> None:
    """Raises if a key is on one side only."""
    one = a.select(*on).withColumn("__a", F.lit(1)).join(b.select(*on).withColumn("__b", F.lit(1)), on, "full").where("__a IS NULL OR __b IS NULL").limit(1)
    if one.count():
        raise ValueError("the two series do not have the same index")
