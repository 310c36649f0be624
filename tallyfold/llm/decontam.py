"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

The test items are the indexed documents and every passage of the training texts is a query. An item's
scores are divided by the least score of a passage that could pass verification, so that one threshold,
1, holds for all items and loses none. Passages are windows of three times the length of the longest item
of their index, at steps of that length, so an occurrence that insertions have made up to twice that long lies
in one whole; of a longer one, parts may be missed. Blocks are runs of
BLOCK items, with a term's best score in each. A passage whose summed best scores stay below 1, over all
items or in a block, has no pivot there and is left at once; WAND searches the blocks that remain.
Retrieved items are verified: of the item's five-word shingles at least 0.8 must be in the passage, and,
where the item marks its answer, of its question's and of its answer's words at least PART each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_columns, make_room, prepare
from .words import SHINGLE, hash_list, shingle_hashes, word_hashes, words

SIMILARITY, PART = 0.8, 0.5
K1, B = 1.2, 0.75
#: Lengths of the longest item in a passage.
SPAN = 3
#: Items of a block.
BLOCK = 8
#: Numbers in an index's table of bounds by word and run of blocks.
CELLS = 1 << 21
#: Numbers of that table that are summed at once.
GATHERED = 1 << 20
#: Text bytes of the items that are broadcast at once; more items make more passes.
INDEX_BYTES = 8 << 20
MATCHES = "array<struct<item_id: bigint, score: double, overlap: double, question_overlap: double, answer_overlap: double>>"
_answer = re.compile(r"(?im)^\s*(?:answer|a)\s*:")
_sentence = re.compile(r"(?<=[.!?])\s+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: at a line that begins with `Answer:` or `A:`; else the last sentence is the answer."""
    if m := _answer.search(text):
        return text[: m.start()], text[m.end() :]
    parts = _sentence.split(text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


@dataclass
class Item:
    """shingles: hashes, ascending; question, answer: numbers of words, ascending."""

    id: int
    shingles: np.ndarray
    question: np.ndarray
    answer: np.ndarray
    marked: bool


def covered(part: np.ndarray, whole: np.ndarray) -> float:
    """share() of ascending numbers without repeats."""
    return len(np.intersect1d(part, whole, assume_unique=True)) / len(part) if len(part) else 1.0


class Postings:
    """For each word the items that have it, ascending, and what it adds to their scores; as flat arrays, so no larger than the items.

    An entry is a word and a block of items that has it: its postings are first[e] to first[e + 1] - 1, bound[e] is the best of them.
    """

    def __init__(self, rows: list[tuple[int, int, float]], terms: int, items: int):
        rows.sort()
        term, self.item, self.gain = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows])
        self.at, self.blocks = np.searchsorted(term, np.arange(terms + 2)), -(-items // BLOCK)
        block = self.item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.block, self.bound = block[first], (np.maximum.reduceat(self.gain, first) if len(first) else np.zeros(0)) * (1 + 1e-6)
        self.first, self.entry_at = np.append(first, len(term)).astype(np.int32), np.searchsorted(term[first], np.arange(terms + 2))
        # bounds of runs of blocks, as many as CELLS allow: most passages end there
        columns = max(1, min(self.blocks, CELLS // (terms + 1)))
        self.runs = np.zeros((terms + 1, columns), np.float32)
        np.maximum.at(self.runs, (term[first], self.block * columns // self.blocks), (self.bound * (1 + 1e-6)).astype(np.float32))
        self.best = self.runs.max(1).astype(np.float64)

    def get(self, t: int, default=()):
        a, z = self.at[t], self.at[t + 1]
        return list(zip(self.item[a:z].tolist(), self.gain[a:z].tolist())) or default

    def entries(self, terms: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The blocks in which the bounds of these words sum to at least 1, and the words' entries there."""
        if (self.runs[terms].sum(0, dtype=np.float64) < 1).all():
            return []
        a, n = self.entry_at[terms], self.entry_at[terms + 1] - self.entry_at[terms]
        every = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        of = self.block[every]
        return [(b, every[of == b]) for b in np.flatnonzero(np.bincount(of, self.bound[every], self.blocks) >= 1).tolist()]

    def reach(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of passages with the words terms[first[k]:first[k + 1]], the places of those whose bounds sum to at least 1 in a run of blocks."""
        per, found = max(1, GATHERED // self.runs.shape[1]), []
        a = 0
        while a < len(first) - 1:
            z = max(a + 1, int(np.searchsorted(first, first[a] + per, side="right")) - 1)
            sums = np.add.reduceat(self.runs[terms[first[a] : first[z]]], first[a:z] - first[a], axis=0, dtype=np.float64)
            found.append(a + np.flatnonzero((sums >= 1).any(1)))
            a = z
        return np.concatenate([np.zeros(0, np.int64), *found])

    def cursors(self, entries: np.ndarray) -> list[list]:
        """For each entry: current item, place, bound, items, gains."""
        spans = zip(self.first[entries].tolist(), self.first[entries + 1].tolist(), self.bound[entries].tolist())
        return [[x[0], 0, b, x, self.gain[a:z].tolist()] for a, z, b in spans for x in [self.item[a:z].tolist()]]


class Index:
    """items: (id, text), each of at least five words. terms: numbers of words from 1 on, shared by the indexes of a pass."""

    def __init__(self, items: list[tuple[int, str]], terms: dict[str, int] | None = None, similarity: float = SIMILARITY):
        self.similarity, self.items, self.terms, token_lists = similarity, [], {} if terms is None else terms, []
        number = lambda ws: np.array(sorted({self.terms.setdefault(t, len(self.terms) + 1) for t in ws}), np.int32)
        for i, text in items:
            w, (q, a) = words(text), split_item(text)
            self.items.append(Item(i, np.unique(shingle_hashes(word_hashes(text))), number(words(q)), number(words(a)), bool(_answer.search(text))))
            token_lists.append(w)
        self.length = max(map(len, token_lists))
        df = Counter(t for w in token_lists for t in set(w))
        n, mean = len(items), sum(map(len, token_lists)) / len(items)
        self.rows: list[tuple[int, int, float]] = []
        for i, w in enumerate(token_lists):
            norm = K1 * (1 - B + B * len(w) / mean)
            gains = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in Counter(w).items()}
            # a word that is missing costs a shingle at least, so so many of the best words may be missing
            lost = math.floor((1 - similarity) * len(self.items[i].shingles) + 1e-9)
            least = sum(sorted(gains.values())[: max(len(gains) - lost, 1)])
            self.rows += [(self.terms.setdefault(t, len(self.terms) + 1), i, g / least * (1 + 1e-9)) for t, g in gains.items()]

    def close(self) -> None:
        """Postings and block bounds, once all indexes of the pass have numbered their words."""
        self.postings = Postings(self.rows, len(self.terms), len(self.items))
        self.best, self.rows = self.postings.best, []

    def wand(self, cursors: list[list], hi: int) -> list[tuple[int, float]]:
        """The items of a block, all below hi, that score at least 1: cursors in order of their items; the first at which the bounds sum to 1 is the pivot."""
        out = []
        while True:
            cursors.sort(key=itemgetter(0))
            bound, pivot = 0.0, hi
            for c in cursors:
                bound += c[2]
                if bound >= 1:
                    pivot = c[0]
                    break
            if pivot >= hi:
                return out
            if cursors[0][0] == pivot:
                score = sum(c[4][c[1]] for c in cursors if c[0] == pivot)
                if score >= 1:
                    out.append((pivot, score))
                pivot += 1
            for c in cursors:
                while c[0] < pivot:
                    c[1] += 1
                    c[0] = c[3][c[1]] if c[1] < len(c[3]) else hi

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items that score at least 1."""
        return [x for b, entries in self.postings.entries(terms) for x in self.wand(self.postings.cursors(entries), min((b + 1) * BLOCK, len(self.items)))]

    def passages(self, at: np.ndarray, term: np.ndarray, before: np.ndarray, begin: np.ndarray, sizes: np.ndarray):
        """(document, first word, numbers of the items' words) of the passages whose summed best scores reach 1, over all items and in a run of blocks.

        at, term, before, begin: of the words of any item among those of all documents, place, number, place of
        the same word before it, and place of its document's first word.
        """
        step, gain = self.length, self.best[term]
        own = np.flatnonzero(gain)
        at, term, before, begin, gain = at[own], term[own], before[own], begin[own], gain[own]
        cells = sizes // step + 1
        base, doc = np.cumsum(cells) - cells, np.searchsorted(np.cumsum(sizes), at, side="right")
        local = (at - begin) // step
        cell, first = base[doc] + local, begin + local * step
        n = int(cells.sum())
        # a word counts at its first place in a window of SPAN cells
        counts = [np.flatnonzero((local >= k) & (before < first - k * step)) for k in range(SPAN)]
        total = np.zeros(n)
        for k, x in enumerate(counts):
            total += np.bincount(cell[x] - k, gain[x], n)
        hot = total >= 1
        counts = [x[hot[cell[x] - k]] for k, x in enumerate(counts)]
        window, words_ = np.concatenate([cell[x] - k for k, x in enumerate(counts)]), np.concatenate([term[x] for x in counts])
        order = np.argsort(window, kind="stable")
        window, words_ = window[order], words_[order]
        edges = np.append(np.flatnonzero(np.diff(window, prepend=-1)), len(window))
        for k in self.postings.reach(words_, edges).tolist():
            c = int(window[edges[k]])
            d = int(np.searchsorted(base, c, side="right")) - 1
            yield d, (c - int(base[d])) * step, words_[edges[k] : edges[k + 1]]


class Pass:
    """Indexes whose items are broadcast together."""

    def __init__(self, groups: list[list[tuple[int, str]]], similarity: float = SIMILARITY):
        self.terms: dict[str, int] = {}
        self.indexes = [Index(g, self.terms, similarity) for g in groups]
        for x in self.indexes:
            x.close()

    def matches(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text item_id, score, overlap, question_overlap, answer_overlap of the verified items, by id; of several passages the best."""
        docs = [words(t) for t in texts]
        sizes = np.array([len(w) for w in docs])
        flat = [t for w in docs for t in w]
        ids = np.fromiter(map(self.terms.get, flat, repeat(0)), np.int64, len(flat))
        at = np.flatnonzero(ids)
        term, starts = ids[at], np.cumsum(sizes) - sizes
        order = np.argsort(term, kind="stable")
        before = np.full(len(at), -1)
        same = term[order[1:]] == term[order[:-1]]
        before[order[1:][same]] = at[order[:-1][same]]
        begin = np.repeat(starts, sizes)[at]
        found: list[dict[int, tuple]] = [{} for _ in texts]
        for index in self.indexes:
            for d, s, scored in index.passages(at, term, before, begin, sizes):
                hits = index.search(np.sort(scored))
                if hits:
                    a, z = starts[d] + s, starts[d] + min(s + SPAN * index.length, sizes[d])
                    terms = np.unique(ids[a:z])
                    terms = terms[terms > 0]
                    have = np.unique(shingle_hashes(hash_list(docs[d][s : s + SPAN * index.length])))
                    for i, score in hits:
                        x = index.items[i]
                        row = (x.id, score, covered(x.shingles, have), covered(x.question, terms), covered(x.answer, terms))
                        if row[2] >= index.similarity - 1e-12 and (not x.marked or min(row[3:]) >= PART) and row[1:] > found[d].get(x.id, (x.id, -1.0))[1:]:
                            found[d][x.id] = row
        return [sorted(f.values()) for f in found]


def passes(benchmark: DataFrame, similarity: float = SIMILARITY):
    """The items in passes of bounded size, each with an index for every class of lengths (powers of two); one pass at a time is on the driver."""
    items = ensure_columns(benchmark, item_id="bigint", text="string").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = max(1, -(-2 * total // INDEX_BYTES))
    for k in range(shares):
        groups: dict[int, list] = {}
        for i, text in sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shares)) == k).select("item_id", "text").collect()):
            if (n := len(words(text))) >= SHINGLE:
                groups.setdefault(n.bit_length(), []).append((i, text))
        if groups:
            yield Pass([groups[k] for k in sorted(groups)], similarity)


def with_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs and matches, an array of (item_id, score, overlap, question_overlap, answer_overlap).

    Items without an id or with fewer than five words take no part; repeated items count once. Null and
    empty texts match nothing. Score is 1 at the least that a verified passage can have. Other columns
    stay; one named matches stays as matches_in. No items, or no documents: no matches.
    """
    spark = prepare(docs.sparkSession)
    docs = make_room(docs, "matches")
    found = F.expr(f"cast(array() as {MATCHES})")
    for one in passes(benchmark, similarity):
        held = spark.sparkContext.broadcast(one)

        @F.pandas_udf(MATCHES)
        def match(texts, held=held):
            import pandas as pd

            names = ("item_id", "score", "overlap", "question_overlap", "answer_overlap")
            return pd.Series([[dict(zip(names, row)) for row in rows] for rows in held.value.matches(texts.tolist())])

        found = F.concat(found, match("text"))
    return docs.withColumn("matches", found)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, score, overlap, question_overlap, answer_overlap."""
    rows = with_matches(ensure_columns(docs, doc_id="bigint", text="string"), benchmark, similarity)
    return rows.select("doc_id", F.inline("matches"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that hold an item; nulls, repeats and clashing names as in with_matches()."""
    return with_matches(docs, benchmark, similarity).where(F.size("matches") == 0).drop("matches")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
