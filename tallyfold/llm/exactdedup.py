"""Exact dedup by a tree of merged digest runs, with DataFrame functions only.

Each partition of the input is a run: its distinct digests in order, each with its count and with the row that is best
so far. Runs then meet in binomial rounds. In a round, partitions whose numbers agree but for one digit (DIGIT bits)
exchange: of each run, the partition that has the digit of the digest gets the rows, merges the 2^DIGIT sorted runs that
it receives and keeps one row a digest. After the last round the number of a partition is the leading bits of its
digests, so each digest is in one place, and no partition ever holds more than its share. A text with very many copies
is one row in each run from the start, and 2^DIGIT of these become one in every round.

The winners go back down the same way: joined by digest with the runs (a digest is there once in each run), then within
each run with its rows. The identity of a text is its SHA-256, which the result holds anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, prepare, written

#: Bits of a partition's number that one round settles: 2^DIGIT runs are merged at a time.
DIGIT = 4
MAX_BITS = 24
WHITE = " \t\n\x0b\x0c\r"


def digest_rows(docs: DataFrame, text: str, id_col: str, place: Column) -> DataFrame:
    """run, pos (the row's place), doc_id, chars, digest, written: a row for each row of docs."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    hashed = F.sha2(F.translate(whole, WHITE, ""), 256)
    return written(
        docs.select(
            F.spark_partition_id().alias("run"), place.alias("pos"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
            F.char_length(whole).alias("chars"), F.unhex(hashed).alias("digest")
        ), "digests"
    )


def merge_runs(runs: DataFrame, bits: int) -> DataFrame:
    """digest, best, n of all runs (columns node, digest, best, n), by rounds that settle DIGIT bits of node each."""
    place = F.expr(f"cast(conv(hex(substring(digest, 1, 4)), 16, 10) as bigint) >> {32 - bits}")
    merged = runs
    for low in range(0, bits, DIGIT):
        mask = ((1 << min(DIGIT, bits - low)) - 1) << low
        node = F.col("node").bitwiseAND(F.lit(~mask)).bitwiseOR(place.bitwiseAND(F.lit(mask)))
        sent = merged.withColumn("node", node.cast("int")).repartitionById(1 << bits, F.col("node")).sortWithinPartitions("node", "digest")
        merged = sent.groupBy("node", "digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return merged.select("digest", "best", "n")


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", place: Column | None = None) -> DataFrame:
    """A row for each row of docs: pos, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are once ASCII white space is deleted; a null text is an empty one. Of equal texts the row
    of most code points stays, then that of the smallest id (a null id is the largest), then the first of the input:
    repeated rows, even with one id, are rows of their own, and one of them stays. Other columns are not looked at. An
    empty table gives an empty one. pos is place, which tells all rows apart; if none is given, the place in the input.
    """
    spark = prepare(docs.sparkSession)
    rows = digest_rows(docs, text, id_col, F.monotonically_increasing_id() if place is None else place)
    last = rows.agg(F.max("run")).first()[0] or 0
    bits = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")) - 1, last).bit_length(), MAX_BITS)
    best = F.struct((-F.col("chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id"), F.col("pos").alias("pos"))
    node = F.col("run") if last < 1 << bits else F.pmod("run", F.lit(1 << bits))
    runs = written(
        rows.select(node.alias("node"), "digest", best.alias("best")).groupBy("node", "digest").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n")),
        "runs"
    )
    winners = written(merge_runs(runs, bits), "winners").select("digest", F.col("best.id").alias("keep_id"), F.col("best.pos").alias("keep_pos"), F.col("n").alias("group_size"))
    of_run = runs.select("node", "digest").join(winners, "digest")
    return rows.withColumn("node", node).join(of_run, ["node", "digest"]).select(
        "pos", "doc_id", "keep_id", "group_size", (F.col("pos") == F.col("keep_pos")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay (see classes), whole and with all their columns."""
    place = "__place"
    while place in docs.columns:
        place += "_"
    held = written(docs.withColumn(place, F.monotonically_increasing_id()), "held")
    stay = classes(held, text, id_col, F.col(place)).where("kept").select(F.col("pos").alias(place))
    return held.join(stay, place, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op13_exactdedup(spark, sf_dir: str) -> DataFrame:
    docs = ensure_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="bigint", text="string")
    return classes(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS key FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY key) AS group_size,
  doc_id = first_value(doc_id) OVER same AS kept, sha256(key) AS text_sha256
FROM d WINDOW same AS (PARTITION BY key ORDER BY chars DESC, doc_id)
"""
