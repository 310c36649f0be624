"""Token ids in flat binary files: encode with the tokenizers library, write, memory-map, read back.

A part holds a range of ascending ids: part-00007.bin has unsigned little-endian ids and nothing else, of
16 bits each if all ids of the tokenizer fit, else of 32; part-00007.idx has n, then n + 1 offsets of documents within the part, n document ids (all 64-bit)
and n validity bytes (0: the id is null). Where a part begins among all ids is the prefix sum of the parts
before it, kept in parts.json. Parts are written under a task's own name and then renamed, so a task that
runs twice, after a lost executor, leaves the same files.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import zlib
from array import array
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, prepare, scratch_path, text_bytes

END = 2
PART_BYTES = 16 << 20
#: Parts at most; of more text, parts are larger. A part's offsets are in memory, 24 bytes a document.
MAX_PARTS = 20_000
#: Pieces that a worker remembers, and the characters of the longest.
CACHE, LONGEST = 1_000_000, 64
#: Letters (Latin, Cyrillic) or digits are one pre-token, marks after them are the next; an apostrophe may begin either.
_word = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0400-\u0481]+|[0-9]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)").fullmatch
_line = re.compile(r"(\S+)\n(\S+)").fullmatch
_odd = re.compile(r" (?:\s|$)").search
_kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
_others = iter(range(256, 512))
#: The characters that stand for the 256 bytes in a byte-level vocabulary.
ALPHABET = "".join(chr(b if b in _kept else next(_others)) for b in range(256))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_type(n: int) -> str:
    """The numpy type of ids below n."""
    return "<u2" if n <= 1 << 16 else "<u4"


class Pieces(dict):
    """Ids of pieces, found when first asked for. When `size` are remembered, the half asked for longest ago is forgotten."""

    def __init__(self, find, size: int):
        self.find, self.half, self.old = find, size // 2, {}

    def __missing__(self, x: str) -> bytes:
        ids = self.old.get(x) or self.find(x)
        if len(x) <= LONGEST:
            if len(self) >= self.half:
                self.old = self.copy()
                self.clear()
            self[x] = ids
        return ids


class Encoder:
    """Whole texts to little-endian ids, by the tokenizers library.

    Byte-level BPE takes a space as the start of the pre-token that follows, so a text may be cut before each
    space that is followed by anything but white space. The ids of the pieces are remembered. A word, the marks
    after it and both sides of a line break are pre-tokens of their own. A word not seen before goes straight to the
    library's BPE model, any other piece is encoded as a text. A text with other white space after a space is
    encoded as it is, and so are all texts if the tokenizer splits or normalises in another way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        n, split = self.tok.get_vocab_size(), self.tok.pre_tokenizer
        self.plain = self.tok.normalizer is None and isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space
        self.kind = id_type(n)
        self.id_bytes = [x.tobytes() for x in np.arange(n).astype(self.kind)]
        self.bpe = self.tok.model.tokenize
        self.pieces = Pieces(lambda x: self._piece(x, " ", self.pieces), CACHE * 3 // 4)
        self.heads = Pieces(lambda x: self._piece(x, "", self.heads), CACHE // 4)
        self.tails: dict[str, bytes] = {}  # marks after a word
        self.line_break = self._text("\n")

    def _text(self, text: str) -> bytes:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def _piece(self, x: str, space: str, known: Pieces) -> bytes:
        if x.isascii() and x.isalpha():
            return b"".join([self.id_bytes[t.id] for t in self.bpe(ALPHABET[32] + x if space else x)])
        if m := _word(x):
            word, marks = m.groups()
            if not marks:
                return b"".join([self.id_bytes[t.id] for t in self.bpe(codecs.charmap_decode((space + x).encode(), "strict", ALPHABET)[0])])
            if marks not in self.tails:
                if len(self.tails) >= CACHE // 16:
                    self.tails.clear()
                self.tails[marks] = self._text(marks)
            return known[word] + self.tails[marks]
        if m := _line(x):
            return known[m[1]] + self.line_break + self.heads[m[2]]
        return self._text(space + x)

    def encode(self, texts: list[str]) -> list[bytes]:
        piece, out = self.pieces.__getitem__, []
        for t in texts:
            if not self.plain or _odd(t) or any(x in t for x in self.added):
                out.append(self._text(t))
            else:
                first, *rest = t.split(" ")
                out.append(self.heads[first] + b"".join(map(piece, rest)))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if urlsplit(uri).scheme else f"file://{uri}")


def _put(fs: pafs.FileSystem, path: str, data: list[bytes], mark: str) -> None:
    with fs.open_output_stream(f"{path}.{mark}") as f:
        for x in data:
            f.write(x)
    fs.move(f"{path}.{mark}", path)


def write_token_files(docs: DataFrame, out: str, tokenizer: str | None = None, end: int = END, part_bytes: int = PART_BYTES) -> list[dict]:
    """Writes the files for docs(doc_id, text) in ascending doc_id order (nulls first; equal ids by text) to out.

    Null text is empty; each document ends with the id `end`. Texts of any length are encoded whole, with the
    library's own treatment of added tokens. Repeated rows are documents of their own; other columns are left
    out. Returns parts.json: name, number of documents, ids and the base of each part. An empty table gives
    no parts.
    """
    spark, tokenizer = prepare(docs.sparkSession), tokenizer or tokenizer_path()
    docs = ensure_columns(docs, doc_id="bigint", text="string")
    total, rows = text_bytes(spark, docs)
    fs, root = _fs(out)
    fs.create_dir(root, recursive=True)
    kind = encoder(tokenizer).kind
    tail, width = np.array([end], kind).tobytes(), np.dtype(kind).itemsize

    def write(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        enc, fs = encoder(tokenizer), _fs(out)[0]
        name, mark = f"part-{ctx.partitionId():05d}", str(ctx.taskAttemptId())
        ids, valid, lengths, body = array("q"), [], array("q"), fs.open_output_stream(f"{root}/{name}.bin.{mark}")
        for b in batches:
            ids.extend(b.column("doc_id").fill_null(0).to_pylist())
            valid.append(np.asarray(b.column("doc_id").is_valid()).astype("u1"))
            texts = b.column("text").fill_null("").to_pylist()
            for a in range(0, len(texts), 128):
                for x in enc.encode(texts[a : a + 128]):
                    body.write(x + tail)
                    lengths.append(len(x) // width + 1)
        body.close()
        if not ids:
            fs.delete_file(f"{root}/{name}.bin.{mark}")
            return
        fs.move(f"{root}/{name}.bin.{mark}", f"{root}/{name}.bin")
        offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths))]).astype("<i8")
        _put(
            fs, f"{root}/{name}.idx",
            [np.array([len(ids)], "<i8").tobytes(), offsets.tobytes(), np.asarray(ids).astype("<i8").tobytes(), np.concatenate(valid).tobytes()],
            mark
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())],
            names=["part", "docs", "ids"]
        )

    parts = max(1, min(-(-(total + 64 * rows) // part_bytes), MAX_PARTS))
    tie = F.xxhash64("text")  # a third of the rows may share an id
    ranged = docs.withColumn("tie", tie).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    listed = sorted(ranged.mapInArrow(write, "part string, docs bigint, ids bigint").collect())  # MAX_PARTS rows at most
    base, found = 0, []
    for part, n, ids in listed:
        found.append({"part": part, "docs": n, "ids": ids, "base": base, "type": kind})
        base += ids
    _put(fs, f"{root}/parts.json", [json.dumps(found).encode()], "new")
    return found


def open_part(out: str, part: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, document ids, validity and token ids of a part; the last memory-mapped where the store is a mounted one."""
    fs, root = _fs(out)
    with fs.open_input_file(f"{root}/{part}.idx") as f:
        raw = f.read()
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    offsets, ids = np.frombuffer(raw, "<i8", n + 1, 8), np.frombuffer(raw, "<i8", n, 8 * (n + 2))
    valid = np.frombuffer(raw, "u1", n, 8 * (2 * n + 2))
    if isinstance(fs, pafs.LocalFileSystem):
        tokens = np.memmap(f"{root}/{part}.bin", kind, "r") if offsets[-1] else np.empty(0, kind)
    else:
        with fs.open_input_file(f"{root}/{part}.bin") as f:
            tokens = np.frombuffer(f.read(), kind)
    return offsets, ids, valid, tokens


def read_token_files(spark, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files in out."""
    fs, root = _fs(out)
    with fs.open_input_file(f"{root}/parts.json") as f:
        parts = json.loads(f.read())
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not parts:
        return spark.createDataFrame([], schema)

    def read(batches):
        for b in batches:
            for part, base, kind in zip(*(b.column(c).to_pylist() for c in ("part", "base", "type"))):
                offsets, ids, valid, tokens = open_part(out, part, kind)
                for a in range(0, len(ids), 4096):
                    z = min(a + 4096, len(ids))
                    crc = [zlib.crc32(tokens[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(a, z)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[a:z], pa.int64(), mask=valid[a:z] == 0),
                            pa.array(base + offsets[a:z], pa.int64()),
                            pa.array(offsets[a + 1 : z + 1] - offsets[a:z], pa.int64()), pa.array(crc, pa.int64())
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    table = spark.createDataFrame([(p["part"], p["base"], p["type"], i) for i, p in enumerate(parts)], "part string, base bigint, type string, i int")
    return table.repartitionByRange(min(len(parts), 10_000), "i").select("part", "base", "type").mapInArrow(read, schema)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    return read_token_files(spark, out)
