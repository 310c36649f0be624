"""Bars, alignment and calendar queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import align, calendar
from .base import BARS, GRID, MACRO, PANEL, SNAPSHOT, grid, macro, market_bars, query, rnd, rounded, segment_bars, snapshot, table


@query("daily_bars", f"WITH {BARS} SELECT symbol, session, {rnd('open', 'high', 'low', 'close')}, volume FROM bars")
def daily_bars(spark, sf):
    return rounded(market_bars(spark, sf))


@query("segment_panel_bars", f"WITH {PANEL} SELECT symbol, session, {rnd('open', 'high', 'low', 'close')}, volume FROM panel")
def segment_panel_bars(spark, sf):
    return rounded(segment_bars(spark, sf))


@query("spine_left_align", f"WITH {BARS},{MACRO} SELECT symbol, session, {rnd('close', 'vix', 'dgs3mo')} FROM bars LEFT JOIN macro USING (session)")
def spine_left_align(spark, sf):
    return rounded(align.left_align(market_bars(spark, sf), macro(spark, sf), ["session"]).select("symbol", "session", "close", "vix", "dgs3mo"))


# every ninth day has a rate, so that gaps are longer than the limit
_SPARSE = "CASE WHEN day(session) % 9 = 0 THEN {} END"


@query(
    "bounded_ffill_coverage",
    f"""WITH {BARS},{MACRO},
j AS (SELECT symbol, session, {_SPARSE.format('vix')} AS vix, {_SPARSE.format('dgs3mo')} AS dgs3mo FROM bars LEFT JOIN macro USING (session)),
f AS (SELECT *, last_value(vix IGNORE NULLS) OVER w AS vix_f, last_value(dgs3mo IGNORE NULLS) OVER w AS dgs3mo_f FROM j
  WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
l AS (SELECT symbol, 'vix' AS series_name, vix AS raw, vix_f AS full_value FROM f UNION ALL SELECT symbol, 'dgs3mo', dgs3mo, dgs3mo_f FROM f)
SELECT symbol, series_name, count(raw) AS n_native, count(*) - count(raw) AS n_missing, count(full_value) - count(raw) AS n_filled, count(*) - count(full_value) AS n_unresolved
FROM l GROUP BY 1, 2""",
)
def bounded_ffill_coverage(spark, sf):
    joined = align.left_align(market_bars(spark, sf), macro(spark, sf), ["session"])
    sparse = joined.select("symbol", "session", *(F.when(F.dayofmonth("session") % 9 == 0, F.col(c)).alias(c) for c in ("vix", "dgs3mo")))
    return align.fill_coverage(sparse, ["vix", "dgs3mo"])


_BUCKETED = f"{GRID}, b AS (SELECT e.event_id, e.ts, g.session FROM events e ASOF LEFT JOIN grid g ON e.ts <= g.close_utc)"


@query("asof_bucket_events", f"WITH {_BUCKETED} SELECT event_id, session FROM b")
def asof_bucket_events(spark, sf):
    return align.asof_bucket(table(spark, sf, "events").select("event_id", "ts"), grid(spark), "ts").select("event_id", "session")


@query(
    "bucket_audit_counts",
    f"""WITH {_BUCKETED}
SELECT count(*) AS n_events, count(*) - count(session) AS n_after_last, count(*) FILTER (session > CAST(ts AS DATE)) AS n_rolled,
  count(*) FILTER (session = CAST(ts AS DATE)) AS n_same_day, count(*) FILTER (strftime(ts - INTERVAL 5 HOUR, '%H:%M') < '09:30') AS n_before_open,
  round(avg(CASE WHEN session > CAST(ts AS DATE) THEN 1.0 ELSE 0.0 END), 8) AS rolled_share FROM b""",
)
def bucket_audit_counts(spark, sf):
    b = align.asof_bucket(table(spark, sf, "events").select("event_id", "ts"), grid(spark), "ts")
    rolled = F.col("session") > F.to_date("ts")
    before = F.date_format(F.from_utc_timestamp("ts", calendar.ZONE), "HH:mm") < "09:30"
    return rounded(
        b.agg(
            F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("session").isNull()).alias("n_after_last"),
            F.count_if(rolled).alias("n_rolled"), F.count_if(F.col("session") == F.to_date("ts")).alias("n_same_day"),
            F.count_if(before).alias("n_before_open"),
            F.avg(F.coalesce(rolled, F.lit(False)).cast("double")).alias("rolled_share")
        )
    )


@query(
    "session_event_totals",
    f"""WITH {_BUCKETED}, t AS (SELECT session, count(*) AS n, sum(value) AS v FROM b JOIN events USING (event_id) WHERE session IS NOT NULL GROUP BY 1)
SELECT g.session, coalesce(t.n, 0) AS n_events, round(coalesce(t.v, 0), 4) + 0.0 AS total FROM grid g LEFT JOIN t USING (session)""",
)
def session_event_totals(spark, sf):
    g = grid(spark)
    b = align.asof_bucket(table(spark, sf, "events").select("event_id", "ts", "value"), g, "ts").where(F.col("session").isNotNull())
    totals = b.groupBy("session").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return rounded(
        g.select("session").join(totals, "session", "left").select(
            "session", F.coalesce("n_events", F.lit(0)).alias("n_events"),
            F.coalesce("total", F.lit(0.0)).alias("total")
        ),
        4
    )


_WEEKDAYS = f"WITH {BARS}, w AS (SELECT DISTINCT session AS s FROM bars WHERE isodow(session) < 6)"


@query(
    "date_rollforward",
    f"{_WEEKDAYS} SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, w.s AS session FROM orders ASOF LEFT JOIN w ON CAST(o_orderdate AS DATE) <= w.s"
)
def date_rollforward(spark, sf):
    days = market_bars(spark, sf).where(F.weekday("session") < 5).select("session").distinct()
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    return align.roll_forward(orders, days, "order_date").select("o_orderkey", "order_date", "session")


@query(
    "trim_leading_incomplete",
    f"""WITH {SNAPSHOT}, r AS (SELECT symbol, session, vix, lag(close, 20) OVER (PARTITION BY symbol ORDER BY session) AS lagged FROM snap),
f AS (SELECT *, min(CASE WHEN vix IS NOT NULL AND lagged IS NOT NULL THEN session END) OVER (PARTITION BY symbol) AS first_whole FROM r)
SELECT symbol, min(session) AS first_session, count(*) AS n_rows, count(*) FILTER (vix IS NULL OR lagged IS NULL) AS n_gaps FROM f WHERE session >= first_whole GROUP BY 1""",
)
def trim_leading_incomplete(spark, sf):
    rows = snapshot(spark, sf).select("symbol", "session", "vix", C.lag("close", 20).alias("lagged"))
    kept = align.trim_leading(rows, ["vix", "lagged"])
    return kept.groupBy("symbol").agg(
        F.min("session").alias("first_session"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("vix").isNull() | F.col("lagged").isNull()).alias("n_gaps")
    )


@query(
    "session_gap_days",
    f"""WITH {BARS} SELECT symbol, session, CAST(date_diff('day', lag(session) OVER w, session) AS INTEGER) AS days_back,
  CAST(coalesce(date_diff('day', session, lead(session) OVER w), 1) AS INTEGER) AS days_ahead FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session)""",
)
def session_gap_days(spark, sf):
    w = C.series()
    return market_bars(spark, sf).select(
        "symbol", "session", F.datediff("session", F.lag("session").over(w)).alias("days_back"),
        F.coalesce(F.datediff(F.lead("session").over(w), "session"), F.lit(1)).alias("days_ahead")
    )


@query(
    "dedup_first_kept",
    "SELECT doc_id, md5(text) AS text_md5, n_copies FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY text) AS n_copies FROM documents) WHERE rn = 1"
)
def dedup_first_kept(spark, sf):
    # min and count combine before the shuffle, so a text with very many copies is no hot key
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return docs.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies")).select("doc_id", "text_md5", "n_copies")


@query("duplicate_counts", "SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_duplicates FROM documents")
def duplicate_counts(spark, sf):
    d = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.md5("text")).alias("n_distinct"))
    return d.withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


@query(
    "wall_time_to_utc",
    """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' EDT' WHEN 1 THEN ' EST' ELSE '' END AS label, date_trunc('minute', ts) AS wall FROM events)
SELECT event_id, strftime(CASE label WHEN ' EDT' THEN wall + INTERVAL 4 HOUR ELSE wall + INTERVAL 5 HOUR END, '%Y-%m-%d %H:%M') AS utc FROM e""",
)
def wall_time_to_utc(spark, sf):
    label = F.when(F.col("event_id") % 3 == 0, " EDT").when(F.col("event_id") % 3 == 1, " EST").otherwise("")
    text = F.concat(F.date_format("ts", "EEEE, MMMM dd, yyyy, hh:mm a"), label)
    rows = table(spark, sf, "events").select("event_id", text.alias("raw"))
    return rows.select("event_id", F.date_format(calendar.wall_to_utc(F.col("raw")), "yyyy-MM-dd HH:mm").alias("utc"))


@query(
    "wall_label_counts",
    "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'EDT' WHEN 1 THEN 'EST' END AS label FROM events) GROUP BY 1"
)
def wall_label_counts(spark, sf):
    label = F.when(F.col("event_id") % 3 == 0, "EDT").when(F.col("event_id") % 3 == 1, "EST")
    counts = table(spark, sf, "events").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))


@query(
    "session_minutes_flags",
    """WITH n AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n_events FROM events GROUP BY 1)
SELECT CAST(d AS DATE) AS session, CASE WHEN d IN (DATE '2024-07-03', DATE '2024-11-29', DATE '2024-12-24') THEN 210 ELSE 390 END AS session_minutes,
  CASE WHEN d IN (DATE '2024-07-03', DATE '2024-11-29', DATE '2024-12-24') THEN 1 ELSE 0 END AS is_half_day, coalesce(n_events, 0) AS n_events
FROM (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2025-01-01', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN n USING (d)
WHERE isodow(d) < 6 AND d NOT IN (DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19', DATE '2024-03-29', DATE '2024-05-27', DATE '2024-06-19', DATE '2024-07-04', DATE '2024-09-02', DATE '2024-11-28', DATE '2024-12-25')""",
)
def session_minutes_flags(spark, sf):
    """Sessions of the events' year, their minutes, and the events of each."""
    n = table(spark, sf, "events").groupBy(F.to_date("ts").alias("session")).agg(F.count(F.lit(1)).alias("n_events"))
    days = calendar.sessions(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31)).select("session", "session_minutes", "is_half_day")
    return days.join(n, "session", "left").na.fill(0, ["n_events"])


@query(
    "month_boundaries",
    f"""WITH {BARS}, m AS (SELECT *, min(session) OVER w AS a, max(session) OVER w AS b FROM bars WINDOW w AS (PARTITION BY symbol, date_trunc('month', session)))
SELECT symbol, session, CASE WHEN session = a THEN 1 ELSE 0 END AS is_month_start, CASE WHEN session = b THEN 1 ELSE 0 END AS is_month_end FROM m""",
)
def month_boundaries(spark, sf):
    from ..operators.features import month_bounds

    m = month_bounds(market_bars(spark, sf))
    return m.select(
        "symbol", "session", C.flag(F.col("session") == F.col("month_first")).alias("is_month_start"),
        C.flag(F.col("session") == F.col("month_last")).alias("is_month_end")
    )


@query(
    "anti_semi_sessions",
    f"WITH {BARS},{MACRO} SELECT session, 'bars_only' AS side FROM bars WHERE session NOT IN (SELECT session FROM macro) UNION ALL SELECT session, 'macro_only' FROM macro WHERE session NOT IN (SELECT session FROM bars)"
)
def anti_semi_sessions(spark, sf):
    b, m = market_bars(spark, sf).select("session"), macro(spark, sf).select("session")
    return b.join(m, "session", "left_anti").withColumn("side", F.lit("bars_only")).unionByName(
        m.join(b, "session", "left_anti").withColumn("side", F.lit("macro_only"))
    )


@query(
    "overlap_window",
    f"WITH {BARS},{MACRO} SELECT greatest(a.lo, b.lo) AS start_session, least(a.hi, b.hi) AS end_session FROM (SELECT min(session) AS lo, max(session) AS hi FROM bars) a, (SELECT min(session) AS lo, max(session) AS hi FROM macro) b"
)
def overlap_window(spark, sf):
    both = [d.agg(F.min("session").alias(f"lo{i}"), F.max("session").alias(f"hi{i}")) for i, d in enumerate((market_bars(spark, sf), macro(spark, sf)))]
    return both[0].crossJoin(both[1]).select(F.greatest("lo0", "lo1").alias("start_session"), F.least("hi0", "hi1").alias("end_session"))  # one row each


@query(
    "asof_next_order",
    """WITH g AS (SELECT o_custkey, o_orderdate AS at, min(o_orderkey) AS next_order FROM orders GROUP BY 1, 2),
e AS (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 90 DAY AS ts FROM orders)
SELECT e.o_orderkey, e.o_custkey, g.next_order FROM e ASOF LEFT JOIN g ON e.o_custkey = g.o_custkey AND e.ts <= g.at""",
)
def asof_next_order(spark, sf):
    """A grid for each customer: the first order 90 days or more after each one."""
    orders = table(spark, sf, "orders")
    events = orders.select("o_orderkey", "o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("ts"))
    grid_ = orders.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("next_order"))
    return align.asof_by(events, grid_, "ts", ["o_custkey"], "o_orderdate", "next_order", "month").drop("ts")
