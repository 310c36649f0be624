"""Session set-up, shared scratch tables and skew-safe joins used by all operators of this package."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlsplit

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: whole texts travel in them, so the default of 10,000 is too many.
ARROW_ROWS = 256
#: A key that holds at least 1/HEAVY of the rows goes by broadcast; there are at most HEAVY of them.
HEAVY = 4096

_ROOT = str(Path(__file__).resolve().parents[2])
_own: dict[str, str] = {}
_made: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and this package on the path of the executors' Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, os.environ.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes see: spark.checkpoint.dir; where that is unset, a temporary one if all runs on this machine, else an error."""
    if at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes see")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tallyfold-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What lies in a folder of this machine is removed when the driver ends; drop_scratch() removes all."""
    _made.append(at := f"{shared_dir(spark)}/tallyfold/{name}-{uuid.uuid4().hex}")
    return at


def drop_scratch() -> int:
    """Removes all tables that operators of this driver have written so far, on any store, and returns their number;
    call it when their results have been written.
    """
    for at in _made:
        fs, path = pafs.FileSystem.from_uri(at if urlsplit(at).scheme else f"file://{at}")
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)
    n = len(_made)
    _made.clear()
    return n


@atexit.register
def _remove() -> None:
    for at in _made:
        if at.startswith(("/", "file:")):
            shutil.rmtree(urlsplit(at).path, ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends there, and a lost executor costs nothing done before."""
    at = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ensure_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns with the named types, missing ones as nulls; all others are left out."""
    return df.select(*(F.col(f"`{c}`").cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """Columns that clash with an operator's own are kept as <name>_in."""
    taken = set(df.columns) | set(names)
    for c in df.columns:
        if c in names:
            new = f"{c}_in"
            while new in taken:
                new += "_in"
            taken.add(new)
            df = df.withColumnRenamed(c, new)
    return df


def text_bytes(spark: SparkSession, docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """UTF-8 bytes of all texts and the number of rows, in one narrow aggregate."""
    row = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")), F.count(F.lit(1))).first()
    return int(row[0] or 0), int(row[1])


def hot_keys(table: DataFrame, keys: list[str], n: str, total: int) -> Column | None:
    """A condition for the keys with at least total/HEAVY rows (there are at most HEAVY), as a list of their hashes; None if there are none."""
    found = table.where(F.col(n) >= max(total // HEAVY, 64)).select(F.xxhash64(*keys)).distinct().collect()
    return F.expr(
        f"xxhash64({', '.join(keys)}) IN ({', '.join(f'{r[0]}L' if r[0] > -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for r in found)})"
    ) if found else None


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with a written table that has each key's number of rows as n.

    Hot keys meet by broadcast (at most HEAVY of them, and what shares their hash), all others by a shuffle in
    which no key has more than 1/HEAVY of the rows.
    """
    hot = hot_keys(table, keys, n, total)
    if hot is None:
        return rows.join(table, keys, how)
    return rows.where(hot).join(F.broadcast(table.where(hot)), keys).unionByName(rows.where(F.coalesce(~hot, F.lit(True))).join(table.where(~hot), keys, how))
