"""Byte-level BPE encoding by a rank file, and decoding.

Overlapping chunk encoding. A long text is cut into chunks that overlap; each is pre-tokenised on its
own, in parallel. Two neighbours are stitched at the first position in their overlap at which both have a
pre-token boundary: from there on they agree. The text from one stitch to the next is then encoded, with
the rest of its chunk as right context, and the ids of the pieces follow one another. Where two neighbours
share no boundary (one pre-token fills the overlap), the text is encoded in one piece. A text of one
chunk is one piece from the start. Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, prepare, written

CHUNK, OVERLAP = 32_768, 512
#: Texts that a worker has as lists of ids at a time.
STEP = 64
#: Characters that a boundary needs to its right, within its chunk, to be one of the whole text too.
CONTEXT = 4


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Bpe:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.size_of = np.array([len(b) for b in self.bytes_of])

    def encode(self, text: str) -> list[int]:
        return self.core.encode_ordinary(text)

    def encode_until(self, text: str, end: int | None) -> list[int]:
        """The ids of text[:end], as they are with the rest to their right; end is a pre-token boundary."""
        ids = self.encode(text)
        if end is None or end >= len(text):
            return ids
        return ids[: int(np.searchsorted(np.cumsum(self.size_of[ids]), len(text[:end].encode()))) + 1] if end else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def boundaries(self, text: str, lo: int, hi: int) -> list[int]:
        """Starts of pre-tokens in [lo, hi), pre-tokenising from 0."""
        return [s for m in self.pattern.finditer(text) if lo <= (s := m.start()) < hi]


_loaded: dict[tuple, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _loaded:
        import public_tokenizers

        _loaded[path] = Bpe(path, public_tokenizers.PATTERN)
    return _loaded[path]


def stitches(heads: list[list[int]], tails: list[list[int]]) -> list[int | None]:
    """For each pair of neighbours, the first boundary in both the left one's tail and the right one's head."""
    return [min(set(t) & set(h), default=None) for t, h in zip(tails[:-1], heads[1:])]


ENCODED = "doc_id bigint, ids array<int>"


def encode_documents(docs: DataFrame, ranks: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, finish: tuple | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every row of docs(doc_id, text).

    finish: a function from encoded to other Arrow batches and the schema of these; it runs in the same Python
    workers, so that ids need not leave them. Null and empty texts give no ids. Equal ids, repeated rows and null ids stay separate rows. Other
    columns are left out. An empty table gives no rows.
    """
    spark, ranks = prepare(docs.sparkSession), ranks or ranks_path()
    docs = ensure_columns(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    if overlap <= 2 * CONTEXT or chunk <= 2 * overlap:
        raise ValueError("chunk > 2 overlap > 4 contexts is needed")
    long = F.length("text") > chunk
    then, schema = finish or ((lambda batches: batches), ENCODED)

    def one(batches):
        enc = bpe(ranks)

        def encoded():
            for b in batches:
                texts = b.column("text")
                for a in range(0, len(texts), STEP):
                    ids = pa.array([enc.encode(t) for t in texts.slice(a, STEP).to_pylist()], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, STEP), ids], names=["doc_id", "ids"])

        return then(encoded())

    short = docs.where(~long).mapInArrow(one, schema)
    step = chunk - overlap
    # equal (doc_id, text) rows have equal results, so a row's content is its key
    chunks = written(
        docs.where(long).withColumn("h", F.xxhash64("text")).groupBy("doc_id", "h", "text").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - overlap - 1) / step).cast("int"))))
        .select(
            "doc_id", "h", "copies", "c", F.substring("text", F.col("c") * step + 1, F.lit(chunk)).alias("text"),
            (F.length("text") > F.col("c") * step + chunk).alias("more")
        ),
        "chunks",
    )
    keys = "doc_id bigint, h bigint, c int"

    def edges(batches):
        enc = bpe(ranks)
        for b in batches:
            heads, tails = [], []
            for c, t, more in zip(b.column("c").to_pylist(), b.column("text").to_pylist(), b.column("more").to_pylist()):
                found = enc.boundaries(t, 0, len(t) - CONTEXT if more else len(t))
                heads.append([c * step + x for x in found if x < overlap] if c else [0])
                tails.append([c * step + x for x in found if x >= step] if more else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), b.column("c"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                names=["doc_id", "h", "c", "head", "tail"]
            )

    seen = written(
        chunks.repartition("doc_id", "h", "c").select("doc_id", "h", "c", "text", "more").mapInArrow(edges, f"{keys}, head array<int>, tail array<int>"),
        "edges"
    )
    left = seen.select("doc_id", "h", "c", "tail").alias("l")
    right = seen.select(F.col("doc_id").alias("rd"), F.col("h").alias("rh"), (F.col("c") - 1).alias("rc"), "head").alias("r")
    cuts = left.join(
        right, F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("h") == F.col("rh")) & (F.col("c") == F.col("rc"))
    ).select("doc_id", "h", "c", F.array_min(F.array_intersect("tail", "head")).alias("cut"))
    per_doc = cuts.groupBy("doc_id", "h").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("cut").isNotNull(), F.struct("c", "cut")))).alias("cuts"),
        F.bool_and(F.col("cut").isNotNull()).alias("stitched")
    )
    begin = F.when(F.col("c") == 0, F.lit(0)).otherwise(F.col("cuts")[F.col("c") - 1] - F.col("c") * step)
    d = per_doc.select(F.col("doc_id").alias("rd"), F.col("h").alias("rh"), "cuts", "stitched")
    same = F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("h") == F.col("rh"))
    pieces = chunks.join(d, same).where("stitched").select(
        "doc_id", "h", "copies", "c", "text", begin.alias("begin"),
        (F.when(F.col("more"), F.col("cuts")[F.col("c")]) - F.col("c") * step).alias("end")
    )
    whole = docs.where(long).withColumn("h", F.xxhash64("text")).join(d.where(~F.col("stitched")), same).select("doc_id", "text")

    def encode_pieces(batches):
        enc = bpe(ranks)
        for b in batches:
            out = [
                enc.encode_until(t[s:], None if e is None else e - s) for t, s,
                e in zip(b.column("text").to_pylist(), b.column("begin").to_pylist(), b.column("end").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), b.column("copies"), b.column("c"), pa.array(out, pa.list_(pa.int32()))],
                names=["doc_id", "h", "copies", "c", "ids"]
            )

    encoded = pieces.mapInArrow(encode_pieces, "doc_id bigint, h bigint, copies bigint, c int, ids array<int>")
    gathered = encoded.groupBy("doc_id", "h", "copies").agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("parts"))
    stitched = gathered.select(
        "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        F.flatten(F.col("parts.ids")).alias("ids")
    ).select("doc_id", "ids")
    if finish:
        stitched = stitched.mapInArrow(then, schema)
    return short.unionByName(stitched).unionByName(whole.mapInArrow(one, schema))


def decoder(ranks: str):
    """From batches of doc_id, ids to batches of doc_id, n_tokens, ids_sha256, decoded."""

    def decode(batches):
        enc = bpe(ranks)
        for b in batches:
            for a in range(0, b.num_rows, STEP):
                ids = [x or [] for x in b.column("ids").slice(a, STEP).to_pylist()]
                shas = [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(a, STEP), pa.array(map(len, ids), pa.int64()),
                        pa.array(shas, pa.string()), pa.array([enc.decode(x) for x in ids], pa.binary())
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded"]
                )

    return decode


DECODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded binary"


def decode_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids -> doc_id, n_tokens, ids_sha256, decoded (raw bytes); ids null: none."""
    return encoded.mapInArrow(decoder(ranks or ranks_path()), DECODED)


def digest(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Encoded, decoded and digested in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = ranks or ranks_path()
    decoded = encode_documents(docs, ranks, finish=(decoder(ranks), DECODED))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
