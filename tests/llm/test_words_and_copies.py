"""Exact dedup, collocations and spelling variants against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from llm.conftest import rows

from tallyfold.llm import collocations, exactdedup, spelling

DATA = "/root/testdata/sf0.001"


def by_sql(spark, query, sql, views):
    db = duckdb.connect()
    for name, at in views.items():
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}')")
    want = db.sql(sql)
    columns = sorted(want.columns)
    got = query(spark, DATA)
    assert sorted(got.columns) == columns
    line = lambda r: tuple(str(r[c]) for c in columns)
    assert sorted(line(r.asDict()) for r in got.collect()) == sorted(line(dict(zip(want.columns, r))) for r in want.fetchall())


@pytest.mark.parametrize("query, sql", [(exactdedup.op13_exactdedup, exactdedup.SQL), (collocations.op11_collocations, collocations.SQL), (spelling.op12_spelling, spelling.SQL)])
def test_queries_by_sql(spark, query, sql):
    by_sql(spark, query, sql, {"documents": f"{DATA}/documents.parquet"})


# ------------------------------------------------------------ exact dedup


def brute_copies(data):
    groups = collections.defaultdict(list)
    for place, (i, t) in enumerate(data):
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, place, i))
    out = []
    for key, members in groups.items():
        keep = min(members)
        out += [(m[4], keep[4], len(members), m[3] == keep[3], hashlib.sha256(key.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("digit", [1, 2, 4])
def test_copies_by_brute_force(spark, messy, nothing, monkeypatch, digit):
    monkeypatch.setattr(exactdedup, "DIGIT", digit)
    r = random.Random(3)
    texts = [r.choice(["a b", "ab", " a\tb", "\x0bab\r", None, "", "é 漢", "é漢", " ab", "A b"]) for _ in range(80)] + ["x y " * 20_000, "xy" * 20_000]
    data = list(zip([*range(80), 200, 199], texts)) + [(5, texts[5]), (5, texts[5]), (None, "ab"), (None, None)]
    df = spark.createDataFrame(rows([t for _, t in data], [i for i, _ in data]), messy.schema).coalesce(1)
    found = lambda d: sorted((tuple(x) for x in exactdedup.classes(d).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert found(df) == brute_copies(data)
    dealt = found(df.repartition(7))
    assert [x[:3] + x[4:] for x in dealt] == [x[:3] + x[4:] for x in brute_copies(data)] and sum(x[3] for x in dealt) == len({x[4] for x in dealt})
    assert exactdedup.classes(nothing).count() == 0
    kept = exactdedup.drop_copies(messy)
    assert kept.columns == messy.columns and kept.count() == len({x[4] for x in brute_copies([(x["doc_id"], x["text"]) for x in messy.collect()])})


# ------------------------------------------------------------ collocations


def brute_phrases(data, least, covered):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in data:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        counts = {g: a for g, a in counts.items() if a >= least}
        lines = []
        for g, a in counts.items():
            if len(g) == 1 or any(100 * b >= covered * a and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in counts.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            lines.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(lines)[:2000])]
    return sorted(out)


def test_phrases_by_brute_force(spark, nothing):
    r = random.Random(7)
    words = ["a", "B", "the", "new", "york", "é", "漢字", "x\x01y", "it's", " ", *(f"w{i}" for i in range(12))]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(n))
    data = [(text(r.randrange(60)), r.choice(["en", "fr", None])) for _ in range(150)] + [("new york city hall " * 400, "en"), (None, "en"), ("", None), (". ! ?", "de")]
    df = spark.createDataFrame(data, "text string, lang string").repartition(5)
    got = sorted(tuple(x) for x in collocations.collocations(df, least=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    want = brute_phrases(data, 3, 80)
    assert len(want) > 100 and got == want
    assert collocations.collocations(nothing).count() == 0


def test_texts_are_cut_in_steps(monkeypatch):
    text = "One, two\tthree. " * 50 + "long " * 40
    whole = [w for step in collocations.steps(text.encode()) for w in step]
    monkeypatch.setattr(collocations, "STEP_BYTES", 7)
    assert [w for step in collocations.steps(text.encode()) for w in step] == whole and len(list(collocations.steps(text.encode()))) > 50


def test_packed_numbers():
    for kind in (np.uint32, np.uint64):
        for x in (np.zeros(0, kind), np.arange(1000, dtype=kind) * 7, np.array([2**31], kind)):
            assert (collocations.unpack(collocations.pack(x), kind) == x).all() and len(collocations.unpack(collocations.pack(x), kind)) == len(x)


# ------------------------------------------------------------ spelling


def brute_variants(counts):
    alphabet = {c for w in counts for c in w}
    out = {}
    for w, n in counts.items():
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for c in alphabet for i in range(len(w) + 1) for k in (0, 1)}
        near = [x for x in near - {w} if x in counts]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= 10 * n else None, n, len(near))
    rows = []
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, near, counts[form] if form else None))
    return sorted(rows)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_variants_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    r = random.Random(hot)
    counts = {"".join(r.choice("abé") for _ in range(r.randrange(7, 11))): r.choice([2, 3, 30, 400, 5000]) for _ in range(700)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(5)
    got = sorted(tuple(x) for x in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute_variants(counts)
    assert spelling.variants(df.where("n < 0")).count() == 0


def test_words_are_counted_with_noise(spark, messy):
    texts = ["Alphabet ALPHABET alphabets, naïvement été-alphabets", "alphabets alphabet " * 3, "Überhaupt überhaupt x1alphabet", None, ""]
    df = messy.unionByName(spark.createDataFrame(rows(texts, [50, 51, 52, 53, None]), messy.schema))
    want = collections.Counter()
    for x in df.collect():
        low = re.sub("[A-Z]", lambda m: m.group().lower(), x["text"] or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if x['doc_id'] is None else x['doc_id']}:{run}".encode())
            want[run if h % 3 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {x["word"]: x["n"] for x in spelling.count_words(df, noise=3).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2} and got
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "abbc") and not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "bac")
