"""Session buckets over a stream of events: the rows of the batch query, as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_table(grid: DataFrame) -> DataFrame:
    """opens (exclusive) and closes (inclusive) of each bucket: from the close before it."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1)).orderBy("close_utc")  # the grid: 252 rows a year
    return grid.select(
        "session", F.col("close_utc").alias("until"),
        F.coalesce(F.lag("close_utc").over(w), F.lit("1900-01-01").cast("timestamp")).alias("after")
    )


def bucket_stream(events: DataFrame, grid: DataFrame, ts: str = "ts") -> DataFrame:
    """Each streamed event with the session in whose bucket it falls (stream-static range join); those after the last close go."""
    b = F.broadcast(bucket_table(grid))
    return events.join(b, (F.col(ts) > F.col("after")) & (F.col(ts) <= F.col("until"))).drop("after", "until")


def session_totals(events: DataFrame, grid: DataFrame, ts: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """session, n_events, total; events later than the watermark are dropped."""
    instants = events.withColumn(ts, F.col(ts).cast("timestamp"))  # a watermark needs instants; wall times count as the session's zone
    kept = bucket_stream(instants.withWatermark(ts, late), grid, ts)
    return kept.groupBy("session").agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total"))


def run_to_table(totals: DataFrame, name: str, checkpoint: str) -> None:
    """Runs over all that is there now and leaves the result in an in-memory table; for tests and small grids."""
    q = totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
