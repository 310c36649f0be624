"""Near-duplicate groups by BagMinHash.

A document is the multiset of its five-word shingles. Each shingle has Poisson processes over a hierarchy
of weight intervals, (0,1], (1,2], (2,4], (4,8] and so on, one independent stream of points an interval; a
point has a time, a register and a place in its interval, and counts if that place is below the shingle's
weight. A register keeps its earliest time over all shingles, so two documents agree in a register with
probability equal to their weighted Jaccard similarity. Points come in ascending order, and a stream ends
when it passes the latest register, so nearly all end at their first point.

Registers are banded. In each bucket of a band the members are linked to a leader, the member with the
most company over all its buckets, and each link is verified on the exact multisets. In nearly all buckets
that puts all members into one component. In the others, the members outside the bucket's largest component
meet all its members, in blocks of BLOCK by BLOCK that are spread over the tasks and compared at once; of
what is similar there, one link for each document and component is passed on and verified. So all
similar texts that share a bucket end in one component, and no group is expanded into pairs of rows.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_columns, lookup, make_room, prepare, written
from .words import GOLDEN, mix, multiset, overlap, shingle_hashes, word_hashes

SIMILARITY = 0.8
#: 40 bands of 6 registers: two documents of similarity 0.8 share no band with probability 5e-6.
BANDS, BAND_ROWS = 40, 6
REGISTERS = BANDS * BAND_ROWS
BATCH = 512
#: Steps of a unit of time, and a time that does not come.
UNIT, NEVER = float(1 << 36), np.iinfo(np.int64).max
#: Members of a block.
BLOCK = 64


def signatures(docs: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Earliest times by document and register, of documents given as shingle hashes with repeats; NEVER for a document without any.

    Times are whole numbers, so that sums do not depend on which documents are taken together.
    """
    out = np.full((len(docs), m), NEVER)
    sizes = np.array([len(d) for d in docs])
    if not sizes.sum():
        return out
    h, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), sizes)
    order = np.argsort(mix(h ^ (doc.astype(np.uint64) * GOLDEN)))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    h, doc, w = h[at], doc[at], np.diff(np.append(at, len(h)))
    # one stream for each weight interval that begins below the weight
    parts, level, lo = [(h, doc, w, np.zeros(len(h)), np.ones(len(h)))], 1, 1
    while (more := w > lo).any():
        k = int(more.sum())
        parts.append((mix(h[more] + np.uint64(level)), doc[more], w[more], np.full(k, float(lo)), np.full(k, float(lo))))
        level, lo = level + 1, 2 * lo
    seed, doc, w, low, width = (np.concatenate(x) for x in zip(*parts))
    time, flat, latest = np.zeros(len(seed), np.int64), out.reshape(-1), np.full(len(docs), NEVER)
    while len(seed):
        k = int(min(max(30_000 // len(seed), 1), 64))
        step = seed[:, None] + np.arange(1, k + 1, dtype=np.uint64) * GOLDEN
        a, b = mix(step), mix(step ^ np.uint64(0xD6E8FEB86659FD93))
        wait = -np.log(((a >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) * (UNIT / width[:, None])
        t = time[:, None] + np.cumsum(wait.astype(np.int64), 1)
        place = low[:, None] + width[:, None] * ((b & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        register = ((b >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        hit = (t < latest[doc][:, None]) & (place < w[:, None])
        np.minimum.at(flat, (doc[:, None] * m + register)[hit], t[hit])
        latest = out.max(1)
        seed, time = step[:, -1], t[:, -1]
        on = time < latest[doc]
        seed, doc, w, low, width, time = seed[on], doc[on], w[on], low[on], width[on], time[on]
    return out


def bands(sig: np.ndarray, n: int = BANDS) -> np.ndarray:
    """A 64-bit key for each document and band; the band's number is part of it."""
    bits = sig.view(np.uint64).reshape(len(sig), n, -1)
    key = np.broadcast_to(np.arange(n, dtype=np.uint64) * GOLDEN, bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        key = mix(key * np.uint64(31) + bits[:, :, i])
    return key.astype(np.int64)


def _band_rows(docs: DataFrame) -> DataFrame:
    """node, bands of every text with words; node stands for the text."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                sh = [shingle_hashes(word_hashes(t)) for t in b.column("text").slice(a, BATCH).to_pylist()]
                some = np.flatnonzero([len(x) for x in sh])
                if len(some):
                    keys = bands(signatures([sh[i] for i in some]))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("node").slice(a, BATCH).take(pa.array(some)), lists], names=["node", "bands"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, bands array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough. texts: node, text. A leader b of many pairs is copied to as many tasks as it needs."""
    fans = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / 128).cast("int").alias("fan")), "fans")
    left = lookup(pairs, fans, ["b"], "n", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("fan")).cast("int")).select("a", "b", "salt")
    first = texts.join(fans, F.col("node") == F.col("b")).select(
        "b", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.col("text").alias("text_b")
    )
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(first, ["b", "salt"]).select("a", "b", "text_a", "text_b")

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 32):
                for a, b, x, y in zip(*(c.to_pylist() for c in batch.slice(i, 32).columns)):
                    if b not in held:
                        if len(held) > 16:
                            held.clear()
                        held[b] = multiset(y)
                    if overlap(multiset(x), held[b]) >= similarity:
                        keep.append((a, b))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: nodes(node, label) after labels have spread along edges(a, b) until each component has its smallest one.

    labels are nodes. From the third round on a node that gets a smaller label hands it to its old one as well, and
    each label is followed to its own, so rounds grow with the logarithm of a chain's length.
    """
    sym = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct()
    sym = written(sym, "links")
    total = sym.count()
    if not total:
        return nodes
    degrees = written(sym.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "degrees")
    for spread in count(1):
        known = nodes.join(degrees, "node")
        sent = lookup(sym, known, ["node"], "n", total).select(F.col("to").alias("node"), "label", F.lit(None).cast("bigint").alias("own"))
        nodes = written(
            sent.unionByName(
                nodes.select("node", "label", F.col("label").alias("own"))
            ).groupBy("node").agg(F.min("label").alias("label"), F.max("own").alias("own")),
            "labels"
        )
        if not nodes.where("label < own").count():
            return nodes.select("node", "label")
        if spread >= 3:
            handed = nodes.where("label < own").select(F.col("own").alias("node"), "label")
            nodes = written(nodes.select("node", "label").unionByName(handed).groupBy("node").agg(F.min("label").alias("label")), "labels")
            further = nodes.select(F.col("node").alias("label"), F.col("label").alias("next")).where("label != next")
            uses = written(further.join(nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label"), "jumps")
            nodes = lookup(nodes, uses, ["label"], "n", total, "left").select("node", F.coalesce("next", "label").alias("label"))
            nodes = written(nodes, "labels")
        nodes = nodes.select("node", "label")


def joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: nodes(node, label), the label the smallest node of a component, after edges(a, b) have joined whole components."""
    total, ends = edges.count(), edges
    if not total:
        return nodes
    for c in ("a", "b"):
        degrees = edges.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        known = written(nodes.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}")).join(degrees, c), "ends")
        ends = lookup(ends, known, [c], "n", total).drop("n")
    links = ends.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a != b").distinct()
    moved = components(nodes.where("node = label"), links).where("label < node").select(F.col("node").alias("label"), F.col("label").alias("least"))
    moved = written(moved.join(nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label"), "moved")
    return lookup(nodes, moved, ["label"], "n", nodes.count(), "left").select("node", F.coalesce("least", "label").alias("label"))


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node, label of the texts that are similar to another text; node = xxhash64 of the text, label the smallest node of the component."""
    spark = prepare(docs.sparkSession)
    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("node"), "text")
    found = _band_rows(texts)
    once = found.groupBy("node").agg(F.first("bands").alias("bands"))
    rows = written(once.select("node", F.explode("bands").alias("key")), "bands")
    counts = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "buckets")
    live = written(lookup(rows, counts, ["key"], "n", rows.count()), "live")
    nodes = written(live.groupBy("node").agg(F.sum("n").alias("company")), "company")
    labels = nodes.select("node", F.col("node").alias("label"))
    near = written(texts.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-texts")
    live_n = live.count()
    if not live_n:
        return labels
    pack = F.shiftleft(F.least("company", F.lit((1 << 31) - 1)), 32).bitwiseOR(F.col("node").bitwiseAND(F.lit(0xFFFFFFFF)))
    chosen = live.join(nodes, "node").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", pack).alias("b"))
    met = lookup(live.select("key", "node"), written(chosen, "leaders"), ["key"], "n", live_n).where("node != b")
    pairs = written(met.select(F.col("node").alias("a"), "b").distinct(), "pairs")
    labels = components(labels, written(verify(pairs, near, similarity), "edges"))
    more = written(_block_links(live, live_n, labels, near, similarity), "more-pairs")
    return joined(labels, written(verify(more, near, similarity), "more-edges"))


def _sketches(texts: DataFrame) -> DataFrame:
    """node, sketch: 32-bit hashes of (shingle, its how-manieth occurrence), ascending; sets whose overlap is that of the multisets, or a little more."""

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                h, n = multiset(t)
                first = np.repeat(np.cumsum(n) - n, n)
                out.append(
                    np.unique((mix(np.repeat(h, n) + (np.arange(n.sum()) - first).astype(np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32)).tobytes()
                )
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out, pa.binary())], names=["node", "sketch"])

    return texts.mapInArrow(run, "node bigint, sketch binary")


def _similar(ask: list[tuple], held: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """For rows (node, label, sketch), of each asking one and each other label the most similar held one, if similar enough."""
    arrays = [np.frombuffer(r[2], np.uint32) for r in (*ask, *held)]
    sizes = np.array([len(x) for x in arrays])
    flat, n = np.concatenate(arrays), int(sizes[: len(ask)].sum())
    shared = np.intersect1d(flat[:n], flat[n:])  # a column for each value that both sides have
    at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
    here = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
    table = np.zeros((len(arrays), len(shared)), np.float32)
    table[np.repeat(np.arange(len(arrays)), sizes)[here], at[here]] = 1
    both = table[: len(ask)] @ table[len(ask) :].T
    hit = both >= (similarity - 1e-6) * (sizes[: len(ask), None] + sizes[None, len(ask) :] - both) - 1
    out = []
    for i, j in zip(*np.nonzero(hit)):
        if ask[i][1] != held[j][1]:
            out.append((float(both[i, j] / (sizes[i] + sizes[len(ask) + j] - both[i, j])), i, j))
    best = {(i, held[j][1]): j for _, i, j in sorted(out)}
    return [(max(a, b), min(a, b)) for (i, _), j in best.items() for a, b in [(ask[i][0], held[j][0])]]


def _block_links(live: DataFrame, live_n: int, labels: DataFrame, near: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b), to be verified, between components that share a bucket."""
    placed = live.select("key", "node").join(labels, "node")
    sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("key").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("label", "k").alias("main")).where("n >= 3 AND most < n")
    mixed = written(
        mixed.select(
            "key", "n", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("held"),
            F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("asking")
        ),
        "mixed"
    )
    rows = written(lookup(placed, mixed, ["key"], "n", live_n), "mixed-rows")
    sketches = _sketches(near.join(rows.select("node").distinct(), "node", "left_semi"))
    rows = rows.join(written(sketches, "sketches"), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = rows.select("key", own(F.col("held")).alias("h"), all_(F.col("asking")).alias("q"), F.lit(0).alias("asks"), "node", "label", "sketch")
    ask = rows.where("label != main").select(
        "key", all_(F.col("held")).alias("h"), own(F.col("asking")).alias("q"), F.lit(1).alias("asks"), "node", "label",
        "sketch"
    )
    dealt = held.unionByName(ask).repartition("key", "h", "q").sortWithinPartitions("key", "h", "q", "asks")

    def run(batches):
        at, sides = None, ([], [])

        def done():
            links = set(_similar(sides[1], sides[0], similarity)) if sides[0] and sides[1] else ()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

        for b in batches:
            for key, h, q, asks, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (key, h, q) != at:
                    yield from done()
                    at, sides = (key, h, q), ([], [])
                sides[asks].append(row)
        yield from done()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, ...) with __node added; and by node: label, n (rows of the text), class_id, class_size."""
    labels = near_groups(docs, similarity)
    docs = docs.withColumn("__node", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    per_text = docs.where(F.col("__node").isNotNull()).groupBy("__node").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("doc_id").cast("bigint")).alias("first"))
    per_text = written(per_text.join(labels.withColumnRenamed("node", "__node"), "__node", "left").withColumn("label", F.coalesce("label", "__node")), "texts")
    per_class = written(
        per_text.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("m")).where("class_size > 1"),
        "classes"
    )
    return docs, written(
        lookup(per_text, per_class, ["label"], "m", per_text.count()).select("__node", "label", "n", "first", "class_id", "class_size"),
        "groups"
    )


def with_groups(docs: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """docs (with __node) and the columns of found as __<name>, NULL where there is no group."""
    named = found.select("__node", F.col("n").alias("__n"), *(F.col(c).alias(f"__{c}") for c in columns))
    return lookup(docs, named, ["__node"], "__n", docs.count(), "left").select(*docs.columns, *(f"__{c}" for c in columns))


def classify(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and class_size of every row of docs(doc_id, text).

    A class is a connected component of texts whose five-word shingles have a weighted Jaccard similarity
    of at least `similarity`; equal texts are in one class, with or without words. A text of fewer than
    five words is one shingle. A row with a null text is a class of its own. Null ids are never smallest;
    a class of null ids only has a null class_id. Repeated rows are rows of one class. Other columns are
    left out; an empty table gives no rows.
    """
    docs, found = groups(ensure_columns(docs, doc_id="bigint", text="string"), similarity)
    rows = with_groups(docs.select("doc_id", "__node"), found, ["class_id", "class_size"])
    alone = F.col("__class_size").isNull()
    return rows.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("__class_id")).alias("class_id"),
        F.coalesce("__class_size", F.lit(1)).cast("long").alias("class_size")
    )


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of classify(): that of the smallest doc_id; of repeated rows any one. Columns stay, clashing ones (__*) as <name>_in."""
    docs = make_room(docs, "__node", "__n", "__class_id", "__best")
    columns = docs.columns
    docs, found = groups(docs, similarity)
    best = found.where(F.col("first").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("__node").alias("chosen")).withColumnRenamed("label", "of")
    marked = found.join(best, F.col("label") == F.col("of"), "left").select("__node", "n", "class_id", (F.col("__node") == F.col("chosen")).alias("best"))
    rows = with_groups(docs, written(marked, "marked"), ["class_id", "best"])
    single = rows.where(F.col("__best").isNull()).select(*columns)
    several = rows.where(F.col("__best") & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__class_id"))).dropDuplicates(["__node"]).select(*columns)
    return single.unionByName(several)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
