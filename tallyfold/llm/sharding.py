"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters the rows uniformly over buckets, by a seeded hash of the row and its place in the input, so that equal
rows scatter too, and writes them; there are as many buckets as keep one in memory. Pass 2 takes each bucket alone, shuffles it (Spark's shuffle() is the inside-out
Fisher-Yates) and appends it to the output order, whose bases are prefix sums of the bucket counts.
Shards are equal ranges of that order, so a bucket's file lies in one shard, seldom in two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns, make_room, prepare, text_bytes, written

LAW = "rows"
#: Text bytes of one bucket, as pass 2 holds a bucket in memory.
BUCKET_BYTES = 16 << 20
#: Prefix sums run within groups of this many buckets and then over the groups.
GROUP = 4096


def text_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + 1


def shard_documents(
    docs: DataFrame, shards: int = 16, seed: int = 20240229, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id",
    text_col: str = "text"
) -> DataFrame:
    """All rows and columns of docs, and: shard (0 to shards - 1), slot (gapless from 0 in a shard).

    Law `rows`: the shards' row counts are at most one apart. Null ids and texts count as values of
    their own; repeated rows are separate rows, dealt apart; texts of any length go whole; an empty table gives
    an empty one; columns named shard, slot or __* are kept as <name>_in. The same seed and the same
    partitions of the input give the same order.
    """
    spark = prepare(docs.sparkSession)
    docs = make_room(docs, "shard", "slot", "__bucket", "__row", "__pos", "__base", "__at", "__n")
    total, rows = text_bytes(spark, docs, text_col)
    buckets = max(1, -(-(total + 64 * rows) // bucket_bytes))
    # the place may differ when a task of a shuffled input runs again, so what was dealt is written before it is counted
    place = F.monotonically_increasing_id()
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), place), F.lit(buckets)).alias("__bucket")
    scattered = written(docs.select(bucket, F.struct("*").alias("__row")), "scattered")

    counts = scattered.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    group = F.floor(F.col("__bucket") / GROUP)
    inside = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__group", group).withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    groups = counts.groupBy("__group").agg(F.sum("__n").alias("__all"))
    ahead = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)  # a row for GROUP buckets
    before = groups.select("__group", F.coalesce(F.sum("__all").over(ahead), F.lit(0)).alias("__before"))
    bases = counts.join(F.broadcast(before), "__group").select("__bucket", (F.col("__inside") + F.col("__before")).alias("__base"))
    if buckets <= 1 << 18:  # 16 bytes a bucket
        bases = F.broadcast(bases)

    # sorted on content first, so that the seeded shuffle starts from one defined order
    gathered = (
        scattered.repartition(min(buckets, 1 << 20), "__bucket")
        .sortWithinPartitions("__bucket", F.col(f"__row.{id_col}"), F.crc32(F.col(f"__row.{text_col}")))
        .groupBy("__bucket")
        .agg(F.collect_list("__row").alias("__rows"))
        .select("__bucket", F.shuffle("__rows", seed).alias("__rows"))
        .join(bases, "__bucket")
        .select("__base", F.posexplode("__rows").alias("__pos", "__row"))
    )
    placed = gathered.select("__row", (F.col("__base") + F.col("__pos")).cast("long").alias("__at"))
    placed = placed.withColumn("shard", F.expr(f"cast(__at * {shards} div {max(rows, 1)} as int)"))
    first = F.expr(f"(cast(shard as long) * {rows} + {shards - 1}) div {shards}")
    return placed.select("__row.*", "shard", (F.col("__at") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; each task writes the buckets that it holds, in slot order."""
    sharded.write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(shard_documents(ensure_columns(docs, doc_id="bigint", text="string")))


def digest(sharded: DataFrame) -> DataFrame:
    text = F.col("text")
    return sharded.select(
        "doc_id", text_size(text).alias("size"), F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
