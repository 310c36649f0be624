"""A rule-based exchange calendar: sessions, closing instants, minutes and half-days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/New_York"


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th (from the end, if negative) given weekday of a month; Monday is 0."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (dt.date(year + month // 12, month % 12 + 1, 1)) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    return dt.date(year, (h + k - 7 * m + 114) // 31, (h + k - 7 * m + 114) % 31 + 1)


def holidays(year: int) -> set[dt.date]:
    """Full-day closures by rule; a fixed date on a Saturday moves to Friday (not New Year's Day), on a Sunday to Monday."""
    out = {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - dt.timedelta(2), _nth(year, 5, 0, -1), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)}
    fixed = [(1, 1), (7, 4), (12, 25)] + [(6, 19)] * (year >= 2022)
    for month, day in fixed:
        d = dt.date(year, month, day)
        if d.weekday() == 5 and month != 1:
            out.add(d - dt.timedelta(1))
        elif d.weekday() == 6:
            out.add(d + dt.timedelta(1))
        elif d.weekday() < 5:
            out.add(d)
    return out


def half_days(year: int) -> set[dt.date]:
    """Early closes at 13:00: before Independence Day, after Thanksgiving, Christmas Eve; weekdays only."""
    days = {dt.date(year, 7, 3), _nth(year, 11, 3, 4) + dt.timedelta(1), dt.date(year, 12, 24)}
    return {d for d in days if d.weekday() < 5 and d not in holidays(year) and not (d.month == 7 and dt.date(year, 7, 4).weekday() >= 5)}


def sessions(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """session, open_utc, close_utc, session_minutes, is_half_day for each trading day from start to end."""
    rows, d = [], start
    while d <= end:
        if d.weekday() < 5 and d not in holidays(d.year):
            rows.append((d, d in half_days(d.year)))
        d += dt.timedelta(1)
    df = spark.createDataFrame(rows, "session date, half boolean")
    at = lambda t: F.to_utc_timestamp(F.to_timestamp(F.concat(F.col("session").cast("string"), F.lit(f" {t}"))), ZONE)
    df = df.withColumn("open_utc", at("09:30:00")).withColumn("close_utc", F.when(F.col("half"), at("13:00:00")).otherwise(at("16:00:00")))
    return df.select(
        "session", "open_utc", "close_utc",
        ((F.unix_timestamp("close_utc") - F.unix_timestamp("open_utc")) / 60).cast("int").alias("session_minutes"),
        F.col("half").cast("int").alias("is_half_day")
    )


def wall_to_utc(text: F.Column) -> F.Column:
    """Instants of wall times such as `Saturday, July 13, 2024, 03:09 pm EDT`.

    A label EDT or EST sets the offset; without one New York's rule does: the first of two equal wall times,
    and times that do not exist move forward. Texts that do not parse are NULL.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]+,\s*(?=[A-Za-z]+ \d)", ""), r"\s+(?!AM|PM)[A-Z]{2,4}$", "")
    wall = F.try_to_timestamp(F.upper(plain), F.lit("MMMM d, yyyy, hh:mm a"))
    label = F.regexp_extract(F.trim(text), r"\b([A-Z]{2,4})$", 1)
    hours = F.when(label == "EDT", F.lit(4)).when(label == "EST", F.lit(5))
    return F.when(hours.isNotNull(), wall + F.make_interval(hours=hours)).otherwise(F.to_utc_timestamp(wall, ZONE))
