"""Phrase collocation mining over integer-coded pieces.

1. Bundles of whole texts are tokenised (tokenise): each yields, for each of its languages, a table of its words with
   counts, and its pieces as numbers into that table, 0 for a break.
2. Words with at least MIN_COUNT occurrences in their language get dense ids (dictionary). A bundle gets the ids of its
   own words by a join, so no dictionary is ever held whole; pieces break at all other words, since no phrase that
   counts can hold one.
3. Pairs of neighbouring ids are packed into 64-bit keys. A bundle sorts its keys and counts runs of equal ones, splits
   them by ranges of a scrambled key, which are equally full whatever the data, and sends each range's sorted keys, packed,
   to that range's task. There they are sorted together, and equal runs counted (count_runs).
4. A pair that reaches MIN_COUNT gets an id of its own, which goes back to the bundles that sent it. Triples and
   quadruples are pairs of overlapping pair ids, so their keys are 64 bits as well; only phrases of frequent pairs
   are counted at all.
5. Scores are joins of the phrases with the counts of their parts (scored).

A frequent phrase, however common, is one entry of each bundle. All steps but the last hold a bundle, or a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns, prepare, written
from .words import mix

MIN_COUNT = 30
#: The best phrases of each language that are reported.
TOP = 2000
#: Drop a phrase that at least COVERED percent of the time is part of one longer candidate.
COVERED = 80
SCALE = 2_000_000
#: Bytes of text of a bundle, tokens for each range of keys, keys that a task gathers from its bundles where no reply is due.
BUNDLE_BYTES = 32 << 20
RANGE_TOKENS = 2 << 20
GATHER_KEYS = 4 << 20
#: Texts are cut into words in steps of about this many bytes.
STEP_BYTES = 1 << 20
NO_LANG = "und"

_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b".........." + b" " + b"abcdefghijklmnopqrstuvwxyz")
_PAIR = np.uint64(32)


def pack(a: np.ndarray) -> bytes:
    """Numbers, compressed by planes of bytes: those of sorted or small numbers are nearly constant."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 3)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, `.` for a break, a step at a time; steps end at breaks or spaces."""
    t, at = text.translate(_TABLE), 0
    while at < len(t):
        end = at + STEP_BYTES
        if end < len(t):
            ends = [x for x in (t.find(b".", end), t.find(b" ", end)) if x >= 0]
            end = min(ends) if ends else len(t)
        yield t[at:end].replace(b".", b" . ").split()
        at = end


class Numbers(dict):
    """Numbers of words, from 1, in order of appearance; 0 is a break."""

    def __init__(self):
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Bundle:
    def __init__(self):
        self.numbers, self.ids, self.size = Numbers(), [], 0

    def add(self, text: bytes) -> None:
        for words in steps(text):
            self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.ids.append(np.zeros(1, np.uint32))
        self.size += len(text)


_TOKENS = "src bigint, lang string, tokens bigint, words array<string>, counts array<bigint>, ids binary"
_TOKENS_ARROW = pa.schema([("src", pa.int64()), ("lang", pa.string()), ("tokens", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])


def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each language of each bundle of texts (columns text, lang)."""
    src, held, size = TaskContext.get().partitionId() << 32, {}, 0

    def flush():
        nonlocal src
        for lang, b in held.items():
            ids = np.concatenate(b.ids)
            counts = np.bincount(ids, minlength=len(b.numbers))[1:]
            words = [w.decode() for w in b.numbers][1:]
            yield pa.RecordBatch.from_pylist([dict(src=src, lang=lang, tokens=int(counts.sum()), words=words, counts=counts, ids=pack(ids))], _TOKENS_ARROW)
            src += 1
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
            text, lang = text.as_py() or b"", lang.as_py()
            held.setdefault(NO_LANG if lang is None else lang, Bundle()).add(text)
            size += len(text)
            if size >= BUNDLE_BYTES:
                yield from flush()
                size = 0
    yield from flush()


def dictionary(bundles: DataFrame, least: int) -> DataFrame:
    """lang, word, a (occurrences), id: the words with at least `least` occurrences in their language, numbered from 1, written."""
    words = bundles.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return written(numbered(written(frequent.withColumn("part", F.spark_partition_id()).withColumn("rank", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "frequent")), "dictionary")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with id, dense from 1: rank (from 0 within part) plus the counts of the parts before. One row a part is summed."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg((F.max("rank") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("id", F.col("base") + F.col("rank") + 1).drop("part", "rank", "base")


def split(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """part, distinct keys in order, their counts: for each range of the scrambled key that has any."""
    keys, counts = np.unique(keys, return_counts=True)
    part = (mix(keys) >> np.uint64(64 - parts.bit_length() + 1)).astype(np.uint32) if parts > 1 else np.zeros(len(keys), np.uint32)
    order = np.argsort(part, kind="stable")
    keys, counts, part = keys[order], counts[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for p, k, c in zip(part[np.r_[0, cuts]] if len(part) else [], np.split(keys, cuts), np.split(counts, cuts)):
        yield int(p), k, c.astype(np.uint32)


def neighbours(ids: np.ndarray) -> np.ndarray:
    """64-bit keys of neighbouring ids, where both are above 0."""
    a, b = ids[:-1], ids[1:]
    both = (a > 0) & (b > 0)
    return a[both].astype(np.uint64) << _PAIR | b[both].astype(np.uint64)


_RUNS = "kind string, src bigint, part int, keys binary, counts binary"
_RUNS_ARROW = pa.schema([("kind", pa.string()), ("src", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _run_rows(kind: str, src: int, keys: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    rows = [dict(kind=kind, src=src, part=p, keys=pack(k), counts=pack(c)) for p, k, c in split(keys, parts)]
    for a in range(0, len(rows), 256):
        yield pa.RecordBatch.from_pylist(rows[a : a + 256], _RUNS_ARROW)


def pair_runs(bundles: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """Rows of kind `ids`: a bundle's pieces by ids of the dictionary; and of kind `2`: its runs of pairs. Written."""
    own = bundles.select("src", "lang", F.posexplode("words").alias("own", "word")).join(found, ["lang", "word"])
    maps = own.groupBy("src").agg(F.collect_list(F.struct((F.col("own") + 1).cast("int").alias("own"), F.col("id"))).alias("map"))
    joined = bundles.select("src", F.size("words").alias("size"), "ids").join(maps, "src")

    def code(batches):
        for b in batches:
            for src, size, blob, m in zip(*(b.column(c) for c in ("src", "size", "ids", "map"))):
                table, pairs = np.zeros(size.as_py() + 1, np.uint32), m.values
                table[pairs.field("own").to_numpy(zero_copy_only=False)] = pairs.field("id").to_numpy(zero_copy_only=False)
                ids = table[unpack(blob.as_py(), np.uint32)]
                near = ids > 0
                ids = ids[near | np.r_[False, near[:-1]]]  # one 0 between pieces is enough
                yield pa.RecordBatch.from_pylist([dict(kind="ids", src=src.as_py(), keys=pack(ids))], _RUNS_ARROW)
                yield from _run_rows("2", src.as_py(), neighbours(ids), parts)

    return written(joined.mapInArrow(code, _RUNS), "pairs")


class Range:
    """Counts of the keys of one range. Runs are merged whenever they have doubled, so memory is bounded by distinct keys."""

    def __init__(self):
        self.keys, self.counts, self.new, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((keys, counts))
        self.size += len(keys)
        if self.size > max(len(self.keys), 1 << 20):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        counts = np.concatenate([self.counts, *(c.astype(np.uint64) for _, c in self.new)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.new, self.size = [], 0

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        keep = self.counts >= least
        return self.keys[keep], self.counts[keep]


_GRAMS = "kind string, part int, src bigint, rank bigint, x bigint, y bigint, a bigint, keys binary, ranks binary"
_GRAMS_ARROW = pa.schema(
    [("kind", pa.string()), ("part", pa.int32()), ("src", pa.int64()), ("rank", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("a", pa.int64()), ("keys", pa.binary()), ("ranks", pa.binary())]
)


def count_runs(runs: DataFrame, parts: int, replies: bool, least: int) -> DataFrame:
    """Rows for each key that reaches `least`: kind of its runs, part, rank in it, both halves x, y and its count a.

    With replies also rows of kind `reply`: to each bundle, its keys that do, with their ranks. A range's runs are in
    one task, and each task has one range.
    """

    def count(batches):
        ranges, sent = {}, []
        for b in batches:
            for row in b.to_pylist():
                keys = unpack(row["keys"], np.uint64)
                ranges.setdefault((row["kind"], row["part"]), Range()).add(keys, unpack(row["counts"], np.uint32))
                if replies:
                    sent.append((row["part"], row["src"], row["kind"], row["keys"]))
        known = {}
        for (kind, part), r in ranges.items():
            keys, counts = known[kind, part] = r.frequent(least)
            r.keys = r.counts = None
            for a in range(0, len(keys), 65_536):
                k, n = keys[a : a + 65_536], min(65_536, len(keys) - a)
                columns = [[kind] * n, [part] * n, [None] * n, np.arange(a, a + n), (k >> _PAIR).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64), counts[a : a + n].astype(np.int64), [None] * n, [None] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _GRAMS_ARROW)], schema=_GRAMS_ARROW)
        for part, src, kind, blob in sent:
            keys, (all_keys, _) = unpack(blob, np.uint64), known[kind, part]
            at = np.searchsorted(all_keys, keys)
            hit = all_keys[np.minimum(at, len(all_keys) - 1)] == keys if len(all_keys) else np.zeros(len(keys), bool)
            if hit.any():
                yield pa.RecordBatch.from_pylist([dict(kind="reply", part=part, src=src, keys=pack(keys[hit]), ranks=pack(at[hit].astype(np.uint32)))], _GRAMS_ARROW)

    return runs.repartitionById(parts, F.col("part")).mapInArrow(count, _GRAMS)


def long_runs(ids: DataFrame, replies: DataFrame, bases: DataFrame, parts: int) -> DataFrame:
    """Runs of kinds `3` and `4` of each bundle, its pieces (ids) coded anew by ids of pairs: a triple is a pair id and
    the next, a quadruple a pair id and the next but one where the one between is there as well.
    """
    lists = replies.join(bases, "part").groupBy("src").agg(F.collect_list(F.struct("base", "keys", "ranks")).alias("replies"))

    def code(batches):
        held: dict[str, list[np.ndarray]] = {"3": [], "4": []}

        def flush():
            for kind, keys in held.items():
                if keys:
                    yield from _run_rows(kind, 0, np.concatenate(keys), parts)
                    keys.clear()

        for b in batches:
            for blob, found in zip(b.column("ids"), b.column("replies")):
                ids, found = unpack(blob.as_py(), np.uint32), found.as_py()
                keys = np.concatenate([unpack(x["keys"], np.uint64) for x in found])
                numbers = np.concatenate([unpack(x["ranks"], np.uint32).astype(np.int64) + x["base"] + 1 for x in found]).astype(np.uint32)
                order = np.argsort(keys)
                keys, numbers = keys[order], numbers[order]
                own = ids[:-1].astype(np.uint64) << _PAIR | ids[1:].astype(np.uint64)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                pairs = np.where(keys[at] == own, numbers[at], np.uint32(0))
                held["3"].append(neighbours(pairs))
                first, third = pairs[:-2], pairs[2:]
                whole = (first > 0) & (pairs[1:-1] > 0) & (third > 0)
                held["4"].append(first[whole].astype(np.uint64) << _PAIR | third[whole].astype(np.uint64))
                if sum(len(k) for keys in held.values() for k in keys) >= GATHER_KEYS:
                    yield from flush()
        yield from flush()

    return ids.select("src", F.col("keys").alias("ids")).join(lists, "src").mapInArrow(code, _RUNS)


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: (lang, word, a, id) of frequent words; (g, a) of frequent phrases of 1 to 4 words, g their
    ids; (lang, n) of all words. Texts of any length, also without a break, are taken whole; a null text is an empty one.
    """
    spark = prepare(docs.sparkSession)
    wanted = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    bundles = written(wanted.mapInArrow(tokenise, _TOKENS), "bundles")
    totals = written(bundles.groupBy("lang").agg(F.sum("tokens").alias("n")), "totals")
    found = dictionary(bundles, least)
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    parts = 1 << max(int(spark.conf.get("spark.sql.shuffle.partitions")) - 1, tokens // RANGE_TOKENS).bit_length()
    if (found.agg(F.max("id")).first()[0] or 0) >= 1 << 32:
        raise ValueError("more than 2^32 frequent words")
    coded = pair_runs(bundles, found.select("lang", "word", "id"), parts)
    counted = written(count_runs(coded.where("kind = '2'"), parts, True, least), "pair_counts")
    pairs = written(numbered(counted.where("kind = '2'").select("part", "rank", "x", "y", "a")), "pair_ids")
    if (pairs.agg(F.max("id")).first()[0] or 0) >= 1 << 32:
        raise ValueError("more than 2^32 frequent pairs")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = counted.where("kind = '2'").groupBy("part").agg((F.max("rank") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    longer = written(count_runs(long_runs(coded.where("kind = 'ids'"), counted.where("kind = 'reply'").select("part", "src", "keys", "ranks"), bases, parts), parts, False, least), "long_counts")
    first, last = (pairs.select(F.col("id").alias(k), F.col("x").alias(f"{k}1"), F.col("y").alias(f"{k}2")) for k in "xy")
    whole = longer.select("kind", "x", "y", "a").join(first, "x").join(last, "y")
    g = F.when(F.col("kind") == "3", F.array("x1", "x2", "y2")).otherwise(F.array("x1", "x2", "y1", "y2"))
    grams = found.select(F.array("id").alias("g"), "a").unionByName(pairs.select(F.array("x", "y").alias("g"), "a")).unionByName(whole.select(g.alias("g"), "a"))
    return found, written(grams, "grams"), totals


def scored(grams: DataFrame) -> DataFrame:
    """g, a, l, r, score of the phrases of at least two words that no longer phrase covers."""
    phrases = grams.where(F.size("g") >= 2)
    cuts = phrases.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    cuts = cuts.select("g", "a", "k", F.slice("g", F.lit(1), F.col("k")).alias("left"), F.slice("g", F.col("k") + 1, F.size("g") - F.col("k")).alias("right"))
    counts = grams.select("g", "a")
    both = cuts.join(counts.toDF("left", "l"), "left").join(counts.toDF("right", "r"), "right")
    score = F.expr(f"(cast({SCALE} as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = both.withColumn("score", score).groupBy("g", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = grams.where(F.size("g") >= 3).select(
        F.col("a").alias("longer"),
        F.explode(F.expr("flatten(transform(sequence(2, size(g) - 1), m -> transform(sequence(1, size(g) - m + 1), i -> slice(g, i, m))))")).alias("g")
    )
    covered = inner.groupBy("g").agg(F.max("longer").alias("longer"))
    kept = F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(20,0)") < F.lit(COVERED).cast("decimal(3,0)") * F.col("a").cast("decimal(20,0)"))
    return best.join(covered, "g", "left").where(kept).select("g", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, least: int = MIN_COUNT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 4 words that occur at least
    `least` times.

    A null language is NO_LANG, a null or empty text has no words; repeated rows count each. Ties of score and a are
    broken by the phrase. Other columns are not looked at. An empty table gives an empty one.
    """
    found, grams, totals = count_phrases(docs, text, lang, least)
    words = found.select("id", "lang", "word")
    of_lang = scored(grams).withColumn("id", F.col("g")[0]).join(words.select("id", "lang"), "id").drop("id")
    # rank() leaves all ties in, so words are looked up for no more than what can be reported
    near = written(of_lang.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top), "near_top")
    spelled = near.select("g", F.posexplode("g").alias("i", "id")).join(words.select("id", "word"), "id").groupBy("g").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])).alias("phrase")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.join(spelled, "g").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(ensure_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), text="string", lang="string"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece, generate_subscripts(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]'), 1) AS p FROM d),
w AS (SELECT d, lang, p, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (SELECT d, lang, p, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY d, p ORDER BY i)),
f AS (
  SELECT lang, [w1] AS g, count(*) AS a FROM s GROUP BY lang, w1 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2], count(*) FROM s WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM s WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM s WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
k AS (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) >= 2),
c AS (SELECT k.lang, k.g, k.a, k.k, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * k.a) // (x.a + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.g = k.g[1:k.k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k.k + 1:]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
v AS (SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer
  FROM (SELECT *, unnest(range(1, len(g) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(g))) AS m FROM f WHERE len(g) >= 3)) GROUP BY ALL),
z AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, n.n, b.score
  FROM b JOIN n USING (lang) LEFT JOIN v ON v.lang = b.lang AND v.g = b.g WHERE v.longer IS NULL OR 100 * v.longer < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM z QUALIFY rank <= 2000
"""
