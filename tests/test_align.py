import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import weekdays

from tallyfold.operators import align, calendar

UTC = dt.timezone.utc


@pytest.fixture(scope="module")
def grid(spark):
    return calendar.sessions(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31)).persist()


@pytest.mark.parametrize(
    ("wall", "session"),
    [
        (
            "March 11, 2024, 04:00 PM", "2024-03-11"
        ), ("March 11, 2024, 04:01 PM", "2024-03-12"), ("March 16, 2024, 10:00 AM", "2024-03-18"), ("March 29, 2024, 10:00 AM", "2024-04-01"),
        ("July 04, 2024, 09:00 AM", "2024-07-05"), ("July 03, 2024, 02:00 PM", "2024-07-05"), ("July 03, 2024, 01:00 PM", "2024-07-03"), (
            "March 08, 2024, 04:00 PM", "2024-03-08"
        ), ("March 08, 2024, 04:01 PM", "2024-03-11"),
    ],
)
def test_buckets_at_their_bounds(spark, grid, wall, session):
    e = spark.createDataFrame([(wall,)], "raw string").withColumn("ts", calendar.wall_to_utc(F.col("raw")))
    assert str(align.asof_bucket(e, grid, "ts").first()["session"]) == session


def test_after_the_last_close_and_before_the_first(spark, grid):
    e = spark.createDataFrame([(dt.datetime(2025, 1, 5),), (dt.datetime(2023, 1, 5),), (None,)], "ts timestamp")
    got = [r["session"] for r in align.asof_bucket(e, grid, "ts").orderBy("ts").collect()]
    assert got == [None, dt.date(2024, 1, 2), None]


def test_a_label_beats_the_rule(spark):
    rows = spark.createDataFrame(
        [("Saturday, July 13, 2024, 03:09 pm EDT",), ("July 13, 2024, 03:09 PM",), ("January 13, 2024, 03:09 PM EST",), ("nonsense",)],
        "raw string"
    )
    got = [r[0] for r in rows.select(F.date_format(calendar.wall_to_utc(F.col("raw")), "HH:mm")).collect()]
    assert got == ["19:09", "19:09", "20:09", None]


def test_fill_stops_at_the_limit(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(i), 1.0 if i % 9 == 0 else None) for i in range(27)]
    filled = align.forward_fill(spark.createDataFrame(rows, "symbol string, session date, x double"), ["x"])
    assert filled.where("x IS NULL").count() == 9  # three of nine in each gap
    c = align.fill_coverage(spark.createDataFrame(rows, "symbol string, session date, x double"), ["x"]).first()
    assert (c["n_native"], c["n_missing"], c["n_filled"], c["n_unresolved"]) == (3, 24, 15, 9)


def test_roll_forward_and_first_kept(spark, grid):
    d = spark.createDataFrame([(dt.date(2024, 3, 29),), (dt.date(2024, 4, 1),), (dt.date(2025, 2, 1),)], "d date")
    assert [str(r["session"]) for r in align.roll_forward(d, grid, "d").orderBy("d").collect()] == ["2024-04-01", "2024-04-01", "None"]
    k = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, n int")
    assert sorted(tuple(r) for r in align.keep_first(k, ["k"], [F.col("n")]).collect()) == [("a", 1), ("b", 3)]


def test_trim_and_gaps(spark):
    rows = [("A", dt.date(2024, 1, i + 1), x) for i, x in enumerate([None, 1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "symbol string, session date, x double")
    assert align.trim_leading(df, ["x"]).count() == 3
    assert align.interior_gaps(df, ["x"]).first()["n_gaps"] == 1


def test_different_indexes_raise(spark):
    a, b = spark.range(3).withColumnRenamed("id", "k"), spark.range(4).withColumnRenamed("id", "k")
    align.same_index(a, a, ["k"])
    with pytest.raises(ValueError):
        align.same_index(a, b, ["k"])


def test_calendar_rules(spark, grid):
    half = [str(r["session"]) for r in grid.where("is_half_day = 1").orderBy("session").collect()]
    assert half == ["2024-07-03", "2024-11-29", "2024-12-24"]
    assert grid.count() == 252 and grid.where("session_minutes = 210").count() == 3
    assert calendar.easter(2024) == dt.date(2024, 3, 31) and calendar.easter(2025) == dt.date(2025, 4, 20)


def test_closed_spine_caps_and_refuses_gaps(spark):
    days = weekdays(6)
    rows = [("A", d, v) for d, v in zip(days, (None, 1.0, 2.0, 3.0, None, None))]
    out = align.closed_spine(spark.createDataFrame(rows, "symbol string, session date, x double"), ["x"]).orderBy("session").collect()
    assert [r["x"] for r in out] == [1.0, 2.0, 3.0]
    holed = [("A", d, v) for d, v in zip(days, (1.0, None, 2.0, 3.0, None, None))]
    with pytest.raises(ValueError, match="A"):
        align.closed_spine(spark.createDataFrame(holed, "symbol string, session date, x double"), ["x"])


def test_asof_with_a_grid_for_each_key(spark):
    """One key has most events, another grid has no closes in most days; against a plain search, for two units of time."""
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1, tzinfo=UTC)
    moment = lambda: start + dt.timedelta(minutes=rng.randrange(60 * 24 * 40))
    keys = [f"k{i}" for i in range(60)]
    grids = [(k, moment(), n) for k in keys[:-1] for n in range(rng.randrange(1, 30))] + [("k0", None, 99), ("k1", start, 5), ("k1", start, 4)]
    events = [(i, rng.choice(keys) if i % 3 else "k0", moment()) for i in range(1500)] + [(2000, "k0", None), (2001, None, start), (2002, "k1", start)]
    g = spark.createDataFrame(grids, "key string, at timestamp, session int")
    e = spark.createDataFrame(events, "id int, key string, ts timestamp").withColumn("session", F.lit("clash"))
    want = {}
    for i, k, t in events:
        ahead = sorted((a, n) for x, a, n in grids if x == k and a is not None and t is not None and a >= t)
        want[i] = ahead[0][1] if ahead else None
    for unit in ("day", "month"):
        got = align.asof_by(e, g, "ts", ["key"], "at", "session", unit)
        assert got.columns == ["id", "key", "ts", "session"] and {r["id"]: r["session"] for r in got.collect()} == want
    assert align.asof_by(e.limit(0), g, "ts", ["key"], "at").count() == 0
    assert {r["session"] for r in align.asof_by(e, g.limit(0), "ts", ["key"], "at").collect()} == {None}
