"""Spelling variant grouping with Aho-Corasick automata of word halves.

If two words are one edit apart, one half of the first stands in the second unchanged, at its start or at its end, and
of the other half one half again (quarter), on one of its sides. Each shard holds the halves of its words in an automaton,
with the words by quarter behind each half. Words are scanned by the shards that can hold a half of a word near them;
a hit counts if the half is at its place and the lengths agree, and the words behind it that share the quarter are
verified. A pair that is found by several halves counts by the first only, so each word adds up its own near words.

A half shared by more than HOT words is split over shards by quarter. No list of pairs is made.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, prepare, written

MIN_CHARS, MIN_COUNT = 7, 2
#: A word's form has at least RATIO times its count.
RATIO = 10
#: One in NOISE words of a document loses a letter in the query.
NOISE = 31
#: Words that share a half and stay in one shard; rows of a shard.
HOT, SHARD_ROWS = 20_000, 100_000
#: Distinct words that a task counts before it passes them on; bytes of text that are cut into words at a time.
TASK_WORDS, STEP_CHARS = 300_000, 1 << 20

_RUN, _GAP = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")


def runs(text: bytes) -> Iterator[Counter]:
    """Counts of the letter runs of a text with A-Z lower-cased, a step of the text at a time."""
    t, at = text.lower().decode(), 0
    while at < len(t):
        gap = _GAP.search(t, at + STEP_CHARS) if at + STEP_CHARS < len(t) else None
        end = gap.start() if gap else len(t)
        yield Counter(_RUN.findall(t[at:end]))
        at = end


def misspelt(run: str, base: int, noise: int) -> str:
    """The run without one letter, if noise divides the crc32 of what base is the crc32 of, and the run."""
    h = zlib.crc32(run.encode(), base)
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, text: str = "text", id_col: str = "doc_id", noise: int = 0) -> DataFrame:
    """word, n: letter runs of all texts of at least MIN_CHARS letters and MIN_COUNT occurrences.

    With noise, one run in so many loses a letter, as decided by a hash of document id (null: no id) and run.
    """

    def count(batches):
        found: Counter = Counter()

        def flush():
            words = list(found)
            for a in range(0, len(words), 50_000):
                w = words[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([found[x] for x in w], pa.int64())], names=["word", "n"])
            found.clear()

        for b in batches:
            for doc, whole in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                base = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for step in runs(whole.as_py() or b""):
                    for run, m in step.items():
                        if noise:
                            run = misspelt(run, base, noise)
                        if len(run) >= MIN_CHARS:
                            found[run] += m
                if len(found) >= TASK_WORDS:
                    yield from flush()
        yield from flush()

    wanted = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text}`").cast("string"))
    return wanted.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def halves(word: str) -> tuple[str, str]:
    m = len(word) // 2
    return word[:m], word[m:]


def path(v: str, w: str) -> tuple[str, int] | None:
    """The first half and quarter of w that v has at its place: (p, 0), (p, 1), (s, 0) or (s, 1)."""
    p, s = halves(w)
    if v.startswith(p):
        rest, (a, z) = v[len(p) :], halves(s)
        if rest.startswith(a):
            return "p", 0
        if rest.endswith(z):
            return "p", 1
    if v.endswith(s):
        front, (a, z) = v[: len(v) - len(s)], halves(p)
        if front.startswith(a):
            return "s", 0
        if front.endswith(z):
            return "s", 1
    return None


def quarters(kind: str, half: str, word: str, size: int) -> Iterator[tuple[int, int, str]]:
    """Keys (side, size, quarter) by which a word that has the half can share a quarter of a word's other half of that size."""
    rest = word[len(half) :] if kind == "p" else word[: len(word) - len(half)]
    yield 0, size, rest[: size // 2]
    if size - size // 2 <= len(rest):
        yield 1, size, rest[len(rest) - (size - size // 2) :]


class Shard:
    """Halves of words in an automaton, and the words behind each half by quarter."""

    def __init__(self):
        self.behind: dict[tuple[str, str], dict[tuple[int, int, str], list[tuple[str, int]]]] = {}
        self.automaton = ahocorasick.Automaton()

    def hold(self, kind: str, half: str, side: int | None, word: str, n: int) -> None:
        self.automaton.add_word(half, half)
        lists = self.behind.setdefault((kind, half), {})
        for key in quarters(kind, half, word, len(word) - len(half)):
            if side is None or side == key[0]:
                lists.setdefault(key, []).append((word, n))

    def near(self, word: str, asked: set[tuple[str, str, int | None, int | None]]) -> Iterator[tuple[str, int]]:
        """The near words that this shard finds for what is asked: halves with side and size, None for all."""
        for end, half in self.automaton.iter(word):
            for kind in "ps":
                if (end + 1 != len(half) if kind == "p" else end + 1 != len(word)) or (lists := self.behind.get((kind, half))) is None:
                    continue
                left = len(word) - len(half)
                for size in (left - 1, left, left + 1):
                    for key in quarters(kind, half, word, size):
                        if key in lists and ((kind, half, None, None) in asked or (kind, half, key[0], size) in asked):
                            for w, n in lists[key]:
                                if path(word, w) == (kind, key[0]) and one_edit(word, w):
                                    yield w, n


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near (number of near words of its shard), best (largest count), form (its word)."""
    shard, asked, none = Shard(), {}, True
    for b in batches:
        for r in b.to_pylist():
            none = False
            if r["held"]:
                shard.hold(r["kind"], r["half"], r["side"], r["word"], r["n"])
            asked.setdefault(r["word"], set()).add((r["kind"], r["half"], r["side"], r["size"]))
    if none or not shard.behind:
        return
    shard.automaton.make_automaton()
    out = []
    for word, wanted in asked.items():
        found = list(shard.near(word, wanted))
        if found:
            n, form = min((-n, w) for w, n in found)
            out.append((word, len(found), -n, form))
    for a in range(0, len(out), 10_000):
        part = zip(*out[a : a + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best", "form"])


def routes(words: DataFrame) -> DataFrame:
    """kind, half, word, n, held: a word's own halves (held), and the halves that a word near it can have there."""
    size = F.char_length("word")
    pairs = F.array_distinct(F.expr(
        f"flatten(transform(sequence(greatest(char_length(word) - 1, {MIN_CHARS}), char_length(word) + 1), m -> "
        "array(struct('p' AS kind, left(word, m div 2) AS half), struct('s' AS kind, right(word, m - m div 2) AS half))))"
    ))
    own = F.when(F.col("x.kind") == "p", F.expr("char_length(word) div 2")).otherwise(size - F.expr("char_length(word) div 2"))
    return words.select("word", "n", F.explode(pairs).alias("x")).select("word", "n", "x.kind", "x.half", (F.char_length("x.half") == own).alias("held"))


def quarter_routes() -> Column:
    """For a row of a hot half: its routes, an array of (side, size, quarter); as quarters(), for all sizes that a near word can have."""
    rest = "if(kind = 'p', substring(word, char_length(half) + 1), left(word, char_length(word) - char_length(half)))"
    left = "(char_length(word) - char_length(half))"
    return F.expr(
        f"flatten(transform(sequence(greatest({left} - 1, 1), {left} + 1), s -> filter(array("
        f"struct(0 AS side, cast(s as int) AS size, left({rest}, cast(s div 2 as int)) AS quarter), "
        f"struct(1 AS side, cast(s as int) AS size, right({rest}, cast(s - s div 2 as int)) AS quarter)), x -> char_length(x.quarter) = if(x.side = 0, s div 2, s - s div 2))))"
    )


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n: of the words (word, n; distinct) that have a near word, their number, and that of
    largest n (ties: the smallest).
    """
    spark = prepare(words.sparkSession)
    rows = routes(words)
    hot = written(rows.where("held").groupBy("kind", "half").count().where(F.col("count") > HOT).select("kind", "half", F.lit(True).alias("hot")), "hot_halves")
    rows = rows.join(hot, ["kind", "half"], "left")
    plain = rows.where("hot IS NULL").select("kind", "half", F.lit(None).cast("int").alias("side"), F.lit(None).cast("int").alias("size"), F.lit("").alias("quarter"), "word", "n", "held")
    # a held word is behind its own quarters only; it scans by all of them
    fine = rows.where("hot").withColumn("x", F.explode(quarter_routes())).select(
        "kind", "half", "x.side", "x.size", "x.quarter", "word", "n",
        (F.col("held") & (F.col("x.size") == F.char_length("word") - F.char_length("half"))).alias("held")
    )
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * words.count() // SHARD_ROWS)
    found = plain.unionByName(fine).repartition(shards, "kind", "half", "size", "side", "quarter").mapInArrow(scan, "word string, near bigint, best bigint, form string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best")).alias("n"), "form")).alias("x"))
    return best.select("word", "n_near", F.col("x.form").alias("form"), (-F.col("x.n")).alias("form_n"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """word, root: where the chain of (word, form) that starts at a word ends; chains have at most longest links.

    Every round doubles the links that a row spans.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(longest - 1, 0).bit_length()):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
    return at


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of (word, n).

    Words are distinct and have at least MIN_CHARS letters. A form has RATIO times the count of its word, so no chain is
    longer than the digits of the largest count. No words give no rows.
    """
    held = written(words.select("word", "n"), "words")
    near = written(near_words(held), "near")
    rows = held.join(near, "word", "left").withColumn("is_form", F.col("form_n") >= RATIO * F.col("n"))
    rows = rows.select(
        "word", F.when(F.col("is_form"), F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("is_form"), F.col("form_n")).alias("form_n")
    )
    largest = held.agg(F.max("n")).first()[0] or 1
    ends = roots(rows.where("form IS NOT NULL"), int(math.log(largest, RATIO)) + 1)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Null texts have no words, repeated rows count each."""
    docs = ensure_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="bigint", text="string")
    return variants(count_words(docs, noise=NOISE))


SQL = """
WITH RECURSIVE bits AS (SELECT i, 0 AS step, i AS c FROM range(256) t(i) UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT i, c FROM bits WHERE step = 8),
d AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, run, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-zÀ-ÿ]+')) AS run FROM d) GROUP BY ALL),
u AS (SELECT row_number() OVER () AS id, run, m, concat(doc_id, ':', run) AS whole FROM r),
b AS (SELECT id, unnest(flatten(list_transform(string_split(whole, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))) AS byte,
  generate_subscripts(flatten(list_transform(string_split(whole, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)), 1) AS i FROM u),
e AS (SELECT id, byte, count(*) OVER (PARTITION BY id) - i AS after, count(*) OVER (PARTITION BY id) AS len FROM b),
push AS (SELECT i AS byte, 0 AS after, c FROM crc UNION ALL
  SELECT p.byte, p.after + 1, xor(p.c >> 8, crc.c) FROM push p JOIN crc ON crc.i = p.c & 255 WHERE p.after < (SELECT max(after) FROM e)),
start AS (SELECT 0 AS len, 4294967295 AS c UNION ALL
  SELECT s.len + 1, xor(s.c >> 8, crc.c) FROM start s JOIN crc ON crc.i = s.c & 255 WHERE s.len < (SELECT max(len) FROM e)),
h AS (SELECT e.id, xor(xor(bit_xor(push.c), any_value(start.c)), 4294967295) AS h FROM e JOIN push USING (byte, after) JOIN start ON start.len = e.len GROUP BY e.id),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (
  SELECT m, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM u JOIN h USING (id))
  WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
k AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
x AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS less FROM k),
near AS (
  SELECT a.word, b.word AS other, b.n FROM (SELECT word, n, i, left(word, i) || '_' || substr(word, i + 2) AS mask FROM k) a
    JOIN (SELECT word, n, i, left(word, i) || '_' || substr(word, i + 2) AS mask FROM k) b ON a.mask = b.mask AND a.word <> b.word
  UNION ALL SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.less
  UNION ALL SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.less),
f AS (SELECT w.word, w.n, count(other) AS n_near, first(other ORDER BY near.n DESC, other) AS other, max(near.n) AS other_n FROM w LEFT JOIN near USING (word) GROUP BY w.word, w.n),
g AS (SELECT word, n, n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM f),
chain AS (SELECT word, form AS at FROM g WHERE form IS NOT NULL UNION ALL SELECT chain.word, g.form FROM chain JOIN g ON g.word = chain.at WHERE g.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at FROM chain JOIN g ON g.word = chain.at WHERE g.form IS NULL)
SELECT g.word, form, coalesce(ends.at, g.word) AS root, n, n_near, form_n FROM g LEFT JOIN ends USING (word)
"""
