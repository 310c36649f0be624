"""Removal of repeated 200-byte strings by suffix arrays.

Most bytes lie in no repeat, and suffix sorting all of them is not needed to know that. Each window of 200
bytes is named by the least hash among its 32-byte strings, which depends on its content alone, so equal
windows have equal names. Runs of neighbouring windows of one name are segments. A segment whose name
occurs once, in it as elsewhere, holds no repeat. Segments that are equal as a whole repeat whole. What is left, segments of one name
and different content, at the edges of repeats and at edits, is decided by suffix arrays: segments of a
name meet in one task, which sorts their suffixes by two-stage sorting (directly sort only the suffixes
smaller than their successors, induce the rest by scans of the buckets) and compares adjacent suffixes for a
common prefix of 200 bytes. Names with very many segments would fill a task; theirs are trimmed first: a
32-byte string that occurs once under its name rules out all windows that hold it, and what is left of the
segments at the edges of a very common passage is mostly equal, and decided as a whole. What is not gets a second
name, the least of another hash, under which fewer meet, and goes to suffix arrays again; so up to LEVELS
times. Should a name still have too many, its windows are counted one by one by digests, which Spark combines
before it shuffles them.

Equal texts are taken as one text with a count: all bytes of copies of 200 bytes or more repeat.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_columns, hot_keys, lookup, prepare, scratch_path, text_bytes, written
from .linededup import Pair, filter_bits, probes, twice_seen
from .words import GOLDEN, mix

WIDTH, SEED = 200, 32
#: Starts of one segment at most.
RUN = 4096
#: Text bytes of one bucket of the table of distinct texts.
BUCKET_BYTES = 16 << 20
#: Segment bytes whose suffixes are sorted at a time (whole names; one name alone may have more).
BLOCK_BYTES = 2 << 20
#: Segments of a name that one task takes, or the total through HOT if that is more.
NAME_SEGMENTS, HOT = 256, 4096
#: Times that names with more are trimmed and split, before their windows are counted by digest.
LEVELS = 3
B1, B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def rolling(b: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all strings of `width` bytes, by doubling."""
    out, have, one, n, p = np.zeros(len(b) - width + 1, np.uint64), 0, b.astype(np.uint64) + np.uint64(1), 1, base
    while width:
        if width & 1:
            out = out * p + one[have : have + len(out)]
            have += n
        width >>= 1
        if width:
            one = one[: len(one) - n] * p + one[n:]
            p, n = np.uint64(int(p) ** 2 & 0xFFFFFFFFFFFFFFFF), 2 * n
    return out


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of `width` values."""
    n, m = 1, h
    while 2 * n <= width:
        m = np.minimum(m[: len(m) - n], m[n:])
        n *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - n : width - n + len(h) - width + 1])


def segments(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a text of at least WIDTH bytes: name, content hash, first start and number of starts of each segment, and whether it may repeat itself."""
    seed = mix(rolling(b, SEED, B1))
    name = least(seed, WIDTH - SEED + 1)
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    n = np.diff(np.append(first, len(name)))
    if n.max() > RUN:
        first = np.concatenate([np.arange(a, a + k, RUN) for a, k in zip(first, n)])
        n = np.diff(np.append(first, len(name)))
    # prefix sums of positioned bytes give any substring's hash: sum(b[i] * base^i) * base^-i
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(b), B2)]))
    inverse = np.uint64(pow(int(B2), -1, 1 << 64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(b), inverse)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((mix(b.astype(np.uint64) * GOLDEN + GOLDEN)) * power[:-1])])
    content = mix((sums[first + n + WIDTH - 1] - sums[first]) * back[first] + n.astype(np.uint64) * GOLDEN)
    # the name's string begins again within the segment if the first such place is passed before the end
    passed = np.concatenate([[0], np.cumsum(seed[: len(name)] == name)])
    return name[first], content, first, n, passed[first + n - 1] > passed[first]


def suffix_order(buf: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The positions `wanted` (ascending) in the order of their suffixes in buf, by two-stage sorting.

    Suffixes are compared on WIDTH bytes at least; buf ends with so many bytes after any wanted position.
    """
    # a suffix is smaller than its successor if the first byte that differs says so
    step = np.sign(np.diff(buf.astype(np.int16))).astype(np.int8)
    step[-1] = 1  # the zeros at the end go on for ever, so they count as smaller
    known = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    smaller = step[np.minimum.accumulate(known[::-1])[::-1]] > 0
    # a larger one is induced from its successor, so successors are sorted too, up to the next smaller one
    ends = wanted[np.concatenate([wanted[1:] != wanted[:-1] + 1, [True]])]
    turn = np.minimum.accumulate(np.where(smaller, np.arange(len(smaller)), len(smaller))[::-1])[::-1][ends]
    more = turn - ends
    extra = np.repeat(ends + 1 - np.concatenate([[0], np.cumsum(more)[:-1]]), more) + np.arange(more.sum())
    starts = np.unique(np.concatenate([wanted, extra]))
    padded = np.concatenate([buf, np.zeros(2 * WIDTH, np.uint8)])
    groups_equal = mix(rolling(padded, WIDTH, B2))[starts]
    direct, larger = np.flatnonzero(smaller[starts]), ~smaller[starts]
    # directly sort these by eight bytes at a time; ties go on, unless all their windows are equal
    word = np.zeros(len(padded) - 7, np.uint64)
    for i in range(8):
        word |= padded[i : len(padded) - 7 + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    order = direct[np.argsort(word[starts[direct]], kind="stable")]
    value = word[starts[order]]
    tied = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])
    for depth in range(8, WIDTH + 8, 8):
        size = np.bincount(tied)
        eq = groups_equal[order]
        differs = np.zeros(len(size), bool)
        inner = tied[1:] == tied[:-1]
        differs[tied[1:][inner & (eq[1:] != eq[:-1])]] = True
        go = np.flatnonzero(differs[tied])
        if not len(go):
            break
        key = word[np.minimum(starts[order[go]] + depth, len(word) - 1)]
        new = np.lexsort((key, tied[go]))
        order[go] = order[go][new]
        value = np.zeros(len(order), np.uint64)
        value[go] = key[new]
        tied = np.concatenate([[0], np.cumsum((tied[1:] != tied[:-1]) | (value[1:] != value[:-1]))])
    # induce the others, bucket by bucket of the first byte: the predecessor of a sorted suffix is next in its own bucket
    first = buf[starts]
    by_byte = np.searchsorted(first[order], np.arange(257)) if len(order) else np.zeros(257, int)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(done: np.ndarray) -> None:
        prev = done[done > 0] - 1
        prev = prev[larger[prev] & (starts[prev + 1] == starts[prev] + 1)]
        byte = first[prev]
        for c in np.unique(byte):
            waiting[c].append(prev[byte == c])

    for c in range(256):
        while waiting[c]:
            got = waiting[c].pop(0)
            out.append(got)
            induce(got)
        own = order[by_byte[c] : by_byte[c + 1]]
        if len(own):
            out.append(own)
            induce(own)
    order = starts[np.concatenate(out)]
    return order[np.isin(order, wanted, assume_unique=True)]


def repeated_starts(parts: list[bytes], n: list[int]) -> list[np.ndarray]:
    """Of each part, which of its first n[i] starts begin a WIDTH-byte string that begins anywhere else among all these starts."""
    buf = np.frombuffer(b"".join(parts) + bytes(WIDTH + 8), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
    n = np.array(n)
    starts = np.repeat(base - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    order = suffix_order(buf, starts)
    window = mix(rolling(buf, WIDTH, B2))
    # adjacent suffixes with a common prefix of WIDTH bytes, compared in full where the hashes agree
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(window[a] == window[b])
    same = np.zeros(len(a), bool)
    for k in range(0, len(near), 16_384):
        x = near[k : k + 16_384]
        ok = np.ones(len(x), bool)
        for d in range(0, WIDTH, 8):
            span = np.arange(d, min(d + 8, WIDTH))
            ok &= (buf[a[x][:, None] + span] == buf[b[x][:, None] + span]).all(1)
        same[x] = ok
    hit = np.zeros(len(buf), bool)
    hit[a[same]] = True
    hit[b[same]] = True
    return np.split(hit[starts], np.cumsum(n)[:-1])


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).tolist()))


SEGMENT = "m bigint, h bigint, t1 bigint, t2 bigint, s int, n int, own boolean"
SPAN = "t1 bigint, t2 bigint, s int, n int"


def _scan(texts: DataFrame) -> DataFrame:
    """All segments of the distinct texts: name m, content h, text t1, t2, first start s, number of starts n."""

    def run(batches):
        for b in batches:
            body = b.column("text").cast(pa.binary())
            for a in range(0, b.num_rows, 64):
                cols, at = [], []
                for i, t in enumerate(body.slice(a, 64).to_pylist()):
                    if t and len(t) >= WIDTH:
                        cols.append(segments(np.frombuffer(t, np.uint8)))
                        at += [i] * len(cols[-1][0])
                if cols:
                    m, h, s, n, own = (np.concatenate(x) for x in zip(*cols))
                    pick = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(m.view(np.int64)), pa.array(h.view(np.int64)),
                            b.column("t1").slice(a, 64).take(pick), b.column("t2").slice(a, 64).take(pick),
                            pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own)
                        ],
                        names=["m", "h", "t1", "t2", "s", "n", "own"]
                    )

    return texts.select("text", "t1", "t2").mapInArrow(run, SEGMENT)


def _sorted_spans(segs: DataFrame) -> DataFrame:
    """Repeated starts, as spans, of segments(m, t1, t2, s, n, body) by suffix arrays; all segments of a name are in one partition, sorted."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            out = []
            hits = repeated_starts([x[5] for x in held], [x[4] for x in held])
            for (_, t1, t2, s, _, _), hit in zip(held, hits):
                out += [(t1, t2, s + a, k) for a, k in runs(hit)]
            if out:
                t1, t2, s, n = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32())],
                    names=["t1", "t2", "s", "n"]
                )

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("m", "t1", "t2", "s", "n", "body"))):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield from flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from flush()

    return segs.mapInArrow(run, SPAN)


def _strings(m: int, body: bytes) -> np.ndarray:
    """Hashes of all SEED-byte strings of a segment, with its name."""
    return mix(rolling(np.frombuffer(body, np.uint8), SEED, B2) + np.array([m], np.int64).view(np.uint64))


def _trimmed(segs: DataFrame) -> DataFrame:
    """What is left of segments(m, t1, t2, s, n, body), as such, without the windows that hold a string found once under their name.

    Strings found more than once are in a twice-seen Bloom filter of bounded size; a full one trims less.
    """

    def lows(b):
        for a in range(0, b.num_rows, 64):
            yield [_strings(m, x) for m, x in zip(b.column("m").slice(a, 64).to_pylist(), b.column("body").slice(a, 64).to_pylist())]

    bits = filter_bits(segs.agg(F.sum(F.col("n") + (WIDTH - SEED))).first()[0] or 0)
    held = segs.sparkSession.sparkContext.broadcast(twice_seen(segs.select("m", "body"), lows, bits))

    def cut(batches):
        twice = held.value
        for b in batches:
            out = []
            for m, t1, t2, s, n, body in zip(*(b.column(c).to_pylist() for c in ("m", "t1", "t2", "s", "n", "body"))):
                once = np.concatenate([[0], np.cumsum(~Pair.has(twice, probes(_strings(m, body), bits)))])
                alive = once[WIDTH - SEED + 1 : WIDTH - SEED + 1 + n] == once[:n]
                out += [(m, t1, t2, s + a, k, body[a : a + k + WIDTH - 1]) for a, k in runs(alive)]
            if out:
                m, t1, t2, s, n, body = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(m, pa.int64()), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()),
                        pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(body, pa.binary())
                    ],
                    names=["m", "t1", "t2", "s", "n", "body"]
                )

    return written(segs.mapInArrow(cut, "m bigint, t1 bigint, t2 bigint, s int, n int, body binary"), "trimmed")


def _renamed(segs: DataFrame, level: int) -> DataFrame:
    """segments(m, t1, t2, s, n, body) cut anew: windows of one name are told apart by a second one, the least of another hash of their strings."""

    def run(batches):
        salt = mix(np.array([level + 1], np.uint64))
        for b in batches:
            out = []
            for m, t1, t2, s, n, body in zip(*(b.column(c).to_pylist() for c in ("m", "t1", "t2", "s", "n", "body"))):
                again = least(mix(rolling(np.frombuffer(body, np.uint8), SEED, B1) ^ salt), WIDTH - SEED + 1)[:n]
                name = mix(again ^ np.array([m], np.int64).view(np.uint64)).view(np.int64)
                first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])).tolist()
                out += [(int(name[a]), t1, t2, s + a, z - a, body[a : z + WIDTH - 1]) for a, z in zip(first, [*first[1:], n])]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    names=["m", "t1", "t2", "s", "n", "body"]
                )

    return segs.mapInArrow(run, "m bigint, t1 bigint, t2 bigint, s int, n int, body binary")


def _distinct(segs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Spans of segments(m, t1, t2, s, n, body) that are equal to another one of their name, and one segment of each content."""
    keys = ["m", "h1", "h2"]
    rest = written(segs.withColumn("h1", F.xxhash64("body")).withColumn("h2", F.xxhash64(F.lit(1), "body")), name)
    same = written(
        rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("t1", "t2", "s", "n", "body"), F.xxhash64("t1", "t2", "s")).alias("one")),
        f"{name}-contents"
    )
    again = lookup(rest.drop("body"), same.where("c >= 2").select(*keys, "c"), keys, "c", rest.count()).select("t1", "t2", "s", "n")
    return again, written(same.select("m", "one.*"), f"{name}-distinct")


def _decided(segs: DataFrame, level: int = 0) -> DataFrame:
    """Spans of repeated starts of distinct segments(m, t1, t2, s, n, body) by suffix arrays.

    Names with very many segments are trimmed and given second names, LEVELS times at most.
    """
    total = segs.count()
    if not total:
        return segs.select("t1", "t2", "s", "n")
    counts = written(segs.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > max(NAME_SEGMENTS, total // HOT)), "hot-names")
    hot = hot_keys(counts, ["m"], "k", 0)  # HOT names at most
    cold = segs if hot is None else segs.where(~hot)
    parts = max(8, -(-total // 16_384))
    out = _sorted_spans(cold.repartition(parts, "m").sortWithinPartitions("m", "t1", "t2", "s"))
    if hot is None:
        return out
    rest = written(segs.where(hot), "hot-segments")
    if level == LEVELS:
        return out.unionByName(_window_spans(rest))
    again, left = _distinct(_renamed(_trimmed(rest), level), f"trimmed-{level}")
    return out.unionByName(again).unionByName(_decided(left, level + 1))


def _window_spans(segs: DataFrame) -> DataFrame:
    """The same for names with very many segments: windows by digest."""

    def run(batches):
        for b in batches:
            for t1, t2, s, n, body in zip(*(b.column(c).to_pylist() for c in ("t1", "t2", "s", "n", "body"))):
                x = np.frombuffer(body, np.uint8)
                w1, w2 = mix(rolling(x, WIDTH, B1)), mix(rolling(x, WIDTH, B2) ^ GOLDEN)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(np.full(n, t1)),
                        pa.array(np.full(n, t2)), pa.array(np.arange(s, s + n, dtype=np.int32))
                    ],
                    names=["w1", "w2", "t1", "t2", "s"]
                )

    rows = written(segs.mapInArrow(run, "w1 bigint, w2 bigint, t1 bigint, t2 bigint, s int"), "windows")
    counts = written(rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).where("c >= 2"), "window-counts")
    return lookup(rows, counts, ["w1", "w2"], "c", rows.count()).select("t1", "t2", "s", F.lit(1).alias("n"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """t1, t2, s, n: in text (t1, t2) the starts s to s + n - 1 begin repeated strings. texts: bucketed by t1, t2."""
    segs = written(_scan(texts), "segments")
    names = segs.groupBy("m").agg(
        F.count(F.lit(1)).alias("c"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.bool_or("own").alias("own")
    ).where("c >= 2 or own")
    names = written(names.select("m", "c", (F.col("own") | (F.col("lo") < F.col("hi"))).alias("mixed")), "names")
    live = written(lookup(segs.drop("own"), names, ["m"], "c", segs.count()).drop("c"), "live")
    whole = live.where("not mixed").select("t1", "t2", "s", "n")
    mixed = live.where("mixed").drop("mixed")
    contents = written(
        mixed.groupBy("m", "h").agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("t1", "t2", "s", "n"), F.xxhash64("t1", "t2", "s")).alias("at")),
        "contents"
    )
    again = lookup(mixed, contents.where("c >= 2").select("m", "h", "c"), ["m", "h"], "c", mixed.count()).select("t1", "t2", "s", "n")
    wanted = contents.select("m", "c", "at.*").groupBy("t1", "t2").agg(F.collect_list(F.struct("m", "s", "n", "c")).alias("cuts"))
    raw = F.encode("text", "UTF-8")
    cut = F.transform(
        "cuts",
        lambda x: F.struct(
            x["m"].alias("m"), x["s"].alias("s"), x["n"].alias("n"), x["c"].alias("c"),
            F.substring(raw, x["s"] + 1, x["n"] + (WIDTH - 1)).alias("body")
        )
    )
    bodies = written(texts.join(wanted.hint("shuffle_hash"), ["t1", "t2"]).select("t1", "t2", F.inline(cut)), "bodies")
    # equal segments repeat whole, and are known as `again`; their one representative is here for others to match
    return written(whole.unionByName(again).unionByName(_decided(bodies.select("m", "t1", "t2", "s", "n", "body"))), "spans")


def cut_out(body: bytes, spans: list[tuple[int, int]], keep: bool = True) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and what is left of body, for spans of starts."""
    last, removed, count, kept = 0, 0, 0, []
    end = -1
    for s, n in sorted(spans):
        if s > end:
            if end > 0:
                last = end
            kept.append(body[max(last, 0) : s] if end >= 0 else body[:s])
            count += 1
            removed += n + WIDTH - 1
            end = s + n + WIDTH - 1
        elif s + n + WIDTH - 1 > end:
            removed += s + n + WIDTH - 1 - end
            end = s + n + WIDTH - 1
    kept.append(body[end:] if end >= 0 else body)
    return removed, count, b"".join(kept)


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(doc_id, text); with keep_text also kept, the bytes left.

    A byte goes if a WIDTH-byte string that covers it starts at another place of any row; rows are separate
    documents, also repeated ones; null is empty. Texts of fewer bytes stay. What is left need not be valid
    UTF-8, as cuts fall on bytes. Null and equal ids stay rows of their own, other columns are left out, an
    empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    docs = ensure_columns(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    copies = written(docs.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies")), "copies")
    total, rows = text_bytes(spark, docs)
    buckets = max(1, min(-(-total // BUCKET_BYTES), 50_000))
    table = f"texts_{uuid.uuid4().hex}"
    rows_of = docs.select("t1", "t2", "text")
    # of texts with very many copies, each task sends one
    hot = hot_keys(copies, ["t1", "t2"], "copies", rows)
    if hot is not None:
        rows_of = rows_of.where(~hot).unionByName(rows_of.where(hot).dropDuplicates(["t1", "t2"]))
    distinct = rows_of.repartition(buckets, "t1", "t2").dropDuplicates(["t1", "t2"])
    distinct.write.bucketBy(buckets, "t1", "t2").option("compression", "zstd").option("path", scratch_path(spark, "texts")).saveAsTable(table)
    texts = spark.table(table)
    spans = repeated_spans(texts)
    lists = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    joined = texts.join(lists.hint("shuffle_hash"), ["t1", "t2"], "left").join(copies.hint("shuffle_hash"), ["t1", "t2"])
    names = ["t1", "t2", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text

    def digest(batches):
        for b in batches:
            body = b.column("text").cast(pa.binary())
            for a in range(0, b.num_rows, 256):
                out = []
                for t, spans, c in zip(
                    body.slice(a, 256).to_pylist(), b.column("spans").slice(a, 256).to_pylist(),
                    b.column("copies").slice(a, 256).to_pylist()
                ):
                    found = [(0, len(t) - WIDTH + 1)] if c > 1 and len(t) >= WIDTH else [(x["s"], x["n"]) for x in spans or ()]
                    removed, count, kept = cut_out(t, found)
                    out.append((len(t), removed, count, hashlib.sha256(kept).hexdigest(), kept)[: 4 + keep_text])
                cols = [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(a, 256) for c in ("t1", "t2", "copies")), *cols], names=names)

    schema = "t1 bigint, t2 bigint, copies bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    results = written(joined.select("text", "spans", "copies", "t1", "t2").mapInArrow(digest, schema), "results")
    spark.sql(f"DROP TABLE {table}")
    return lookup(docs.select("doc_id", "t1", "t2"), results, ["t1", "t2"], "copies", rows).select("doc_id", *names[3:])


def op5_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
