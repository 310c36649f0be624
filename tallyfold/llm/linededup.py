"""Line dedup with two Bloom filters.

Each task notes the hashes of its documents' lines in two filters, once-seen and twice-seen. Merging two
pairs of filters is (A1|B1, A2|B2|A1&B1), so the merged twice-seen filter has every line that at least two
documents hold, and some others. It alone is broadcast; its size is bounded by MAX_BITS, beyond which it
only lets more lines through. Lines that hit it are suspected repeats: their 128-bit digests are shuffled,
counted exactly, and the smallest document id is chosen as the one that keeps the line.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, make_room, prepare, text_bytes, written

STRIP = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: Bits of one filter: 16 for each assumed line of LINE_BYTES, within these bounds (32 MB at most).
LINE_BYTES, MIN_BITS, MAX_BITS = 64, 1 << 18, 1 << 28
SEGMENT = 1 << 18
PROBES = 3


def line_key(line: bytes) -> bytes | None:
    """The line stripped of ASCII white space, A-Z lower-cased; None if it has fewer than MIN_CHARS code points."""
    key = line.strip(STRIP)
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS:
        return None
    return key.lower()


def digests(text: bytes | None) -> list[int | None]:
    """A 128-bit digest of each line's key; None for lines that are too short."""
    return [None if (k := line_key(x)) is None else xxhash.xxh3_128_intdigest(k) for x in (text or b"").split(b"\n")]


def probes(low: np.ndarray, bits: int) -> np.ndarray:
    a, b = low & np.uint64(0xFFFFFFFF), (low >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(PROBES)])


class Pair:
    """Once-seen and twice-seen filters, one byte holding 8 bits."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    @staticmethod
    def has(f: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (f[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool).all(0)

    @staticmethod
    def put(f: np.ndarray, p: np.ndarray) -> None:
        p = p.ravel()
        np.bitwise_or.at(f, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def add(self, lows: list[np.ndarray]) -> None:
        """The lines of some documents, each document's without repeats."""
        if not lows or not sum(map(len, lows)):
            return
        new, n = np.unique(np.concatenate(lows), return_counts=True)
        p = probes(new, self.bits)
        again = (n > 1) | self.has(self.once, p)
        self.put(self.twice, p[:, again])
        self.put(self.once, p)


def _lows(texts: list[bytes | None]) -> list[np.ndarray]:
    return [np.fromiter({x & 0xFFFFFFFFFFFFFFFF for x in digests(t) if x is not None}, np.uint64) for t in texts]


def twice_seen(rows: DataFrame, lows, bits: int) -> np.ndarray:
    """The merged twice-seen filter of the 64-bit hashes that lows(batch) yields, as lists of arrays; parts of it
    travel by segment, compressed, and are merged as they arrive.
    """
    size = min(bits, SEGMENT) // 8

    def note(batches: Iterator[pa.RecordBatch]):
        pair = Pair(bits)
        for b in batches:
            for arrays in lows(b):
                pair.add(arrays)
        for s in range(bits // 8 // size):
            once = pair.once[s * size : (s + 1) * size]
            if once.any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s], pa.int32()), pa.array([zlib.compress(once.tobytes(), 1)]),
                        pa.array([zlib.compress(pair.twice[s * size : (s + 1) * size].tobytes(), 1)])
                    ],
                    names=["s", "once", "twice"]
                )

    def merge(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for s, once, twice in zip(*(c.to_pylist() for c in b.columns)):
                a, c = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
                one, two = held.setdefault(s, [np.zeros(size, np.uint8), np.zeros(size, np.uint8)])
                two |= c | (one & a)
                one |= a
        for s, (_, two) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(two.tobytes(), 1)])], names=["s", "twice"])

    segments = rows.mapInArrow(note, "s int, once binary, twice binary")
    merged = segments.repartition(min(bits // 8 // size, 64), "s").mapInArrow(merge, "s int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for s, two in merged.collect():  # at most MAX_BITS / 8 bytes
        out[s * size : (s + 1) * size] = np.frombuffer(zlib.decompress(two), np.uint8)
    return out


def filter_bits(count: int) -> int:
    """Bits of a filter for so many hashes: 16 for each, within bounds."""
    return min(max(MIN_BITS, 1 << int(16 * max(count, 1)).bit_length()), MAX_BITS)


def _line_lows(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    texts = b.column(0).cast(pa.binary())
    for a in range(0, len(texts), 256):
        yield _lows(texts.slice(a, 256).to_pylist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def drop_lists(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """__id, __h (xxhash64 of the text), __drop: digests of the lines that documents of this id and text lose."""
    spark = docs.sparkSession
    total, _ = text_bytes(spark, docs, text)
    bits = filter_bits(total // LINE_BYTES)
    held = spark.sparkContext.broadcast(twice_seen(docs.select(text), _line_lows, bits))

    def suspects(batches: Iterator[pa.RecordBatch]):
        twice = held.value
        for b in batches:
            texts, ids, hs = b.column(0).cast(pa.binary()), b.column(1), b.column(2)
            for a in range(0, b.num_rows, 256):
                found = [list({x for x in digests(t) if x is not None}) for t in texts.slice(a, 256).to_pylist()]
                n = np.array([len(x) for x in found])
                every = [x for d in found for x in d]
                low = np.fromiter((x & 0xFFFFFFFFFFFFFFFF for x in every), np.uint64, len(every))
                high = np.fromiter((x >> 64 for x in every), np.uint64, len(every))
                hit = Pair.has(twice, probes(low, bits)) if len(every) else np.zeros(0, bool)
                doc = pa.array(np.repeat(np.arange(len(found)), n)[hit])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high[hit].astype(np.int64)), pa.array(low[hit].astype(np.int64)), ids.slice(a, 256).take(doc), hs.slice(a, 256).take(doc)],
                    names=["hi", "lo", "__id", "__h"]
                )

    rows = docs.select(F.col(text), F.col(id_col).cast("bigint").alias("__id"), F.xxhash64(text).alias("__h"))
    found = written(rows.mapInArrow(suspects, "hi bigint, lo bigint, __id bigint, __h bigint"), "suspects")
    # a null id is larger than any other
    counted = written(found.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("keeper")).where("n >= 2"), "repeats")
    lost = lookup(found, counted, ["hi", "lo"], "n", found.count()).where(
        F.col("keeper").isNotNull() & (F.col("__id").isNull() | (F.col("__id") > F.col("keeper")))
    )
    return written(lost.groupBy("__id", "__h").agg(F.collect_set(F.struct("hi", "lo")).alias("__drop")), "drops")


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep_columns: bool = True) -> DataFrame:
    """docs with the text that is left, and n_lines (before), n_dropped.

    A key (see line_key) that at least two rows hold loses its lines everywhere but in the rows of the
    smallest id that holds it; rows of the same id all keep theirs; a null id is the largest. A null or
    empty text is one empty line, which is never dropped, and comes back as an empty text. Repeated rows
    are separate documents. Other columns stay; ones named n_lines, n_dropped or __* stay as <name>_in.
    """
    spark = prepare(docs.sparkSession)
    docs = make_room(docs, "n_lines", "n_dropped", "__id", "__h", "__drop", "__row", "__text")
    drops = drop_lists(docs, text, id_col)
    rest = [c for c in docs.columns if c != text] if keep_columns else [id_col]
    rows = docs.select(F.struct(*rest).alias("__row"), F.col(text).alias("__text"), F.col(id_col).cast("bigint").alias("__a"), F.xxhash64(text).alias("__b"))
    right = drops.hint("shuffle_hash")
    joined = rows.join(right, F.col("__a").eqNullSafe(F.col("__id")) & (F.col("__b") == F.col("__h")), "left").select("__row", "__text", "__drop")
    schema = joined.schema

    def apply(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts, lists = b.column("__text").cast(pa.binary()), b.column("__drop")
            out, lines, dropped = [], [], []
            for a in range(0, b.num_rows, 256):
                for t, d in zip(texts.slice(a, 256).to_pylist(), lists.slice(a, 256).to_pylist()):
                    all_lines = (t or b"").split(b"\n")
                    if d:
                        gone = {(x["hi"] & 0xFFFFFFFFFFFFFFFF) << 64 | (x["lo"] & 0xFFFFFFFFFFFFFFFF) for x in d}
                        kept = [x for x, g in zip(all_lines, digests(t)) if g not in gone]
                        t = b"\n".join(kept)
                    else:
                        kept = all_lines
                    out.append(t or b"")
                    lines.append(len(all_lines))
                    dropped.append(len(all_lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [b.column("__row"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                names=["__row", "__text", "n_lines", "n_dropped"]
            )

    from pyspark.sql import types as T

    result = joined.mapInArrow(
        apply,
        T.StructType([schema["__row"], schema["__text"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    )
    order = [F.col("__text").alias(text) if c == text else F.col(f"__row.`{c}`").alias(c) for c in (docs.columns if keep_columns else [id_col, text])]
    return result.select(*order, "n_lines", "n_dropped")


def op10_linededup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(k.doc_id > r.keeper, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
