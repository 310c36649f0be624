import base64
import collections
import hashlib
import re

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from llm.conftest import SCHEMA, prose, rows

from tallyfold.llm import bpe, decontam, langid, linededup, minhash

DATA = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    step = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, step, DATA).persist()
        assert after.columns == docs.columns
        if k == 1:
            want = linededup.dedup_lines(step).select("doc_id", "text")
            assert after.select("doc_id", "text").exceptAll(want).count() == 0
        if k == 2:
            classes = collections.defaultdict(list)
            for r in minhash.classify(step).collect():
                classes[r["class_id"]].append(r["doc_id"])
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(min(v) for v in classes.values())
        if k == 3:
            leaks = {r["doc_id"] for r in decontam.find_leaks(step, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in step.collect()} - {r["doc_id"] for r in after.collect()} == leaks and leaks
        step = after
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == sorted(tuple(r) for r in bpe.digest(step).collect())


def test_stages_take_messy_documents(spark, messy):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() > 0
    rejected = [t for t in ("12 34", None, "") if not langid.has_letter(t)]
    assert len(rejected) == 3
    empty = spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0
    assert rows([]) == []


# ------------------------------------------------------------ the whole pipeline in plain Python, without the operators


def plain_lines(docs):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m.group().lower(), re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", x))
    holders = collections.defaultdict(set)
    for d, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(d)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    return {d: "\n".join(x for x in t.split("\n") if first.get(key(x), d) == d) for d, t in docs.items()}


def plain_shingles(text, n=5):
    w = re.findall(r"\w+", text.lower())
    return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or collections.Counter([tuple(w)] * bool(w))


def plain_firsts(docs):
    ids, bags = list(docs), {d: plain_shingles(t) for d, t in docs.items()}
    group = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if docs[a] == docs[b] or either and both / either >= 0.8:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    least = {}
    for d, g in group.items():
        least[g] = min(least.get(g, d), d)
    return {d: docs[d] for d in least.values()}


def plain_clean(docs, items):
    held = lambda t, x: len(plain_shingles(x).keys() & plain_shingles(t).keys()) / len(plain_shingles(x)) >= 0.8
    return {d: t for d, t in docs.items() if not any(held(t, x) for x in items)}


def test_pipeline_in_plain_python(spark, tmp_path):
    w = prose(901, 90).split()
    edited = " ".join([*w[:40], "changed", *w[41:]])
    items = [prose(902, 30), prose(903, 60)]
    license_line = "This LINE is in many documents, as licences are.  "
    texts = [
        None, "", "12 34 !!", " ".join(w), edited, " ".join(w), prose(904, 70) + " " + items[0] + " " + prose(905, 40),
        items[1].upper(), prose(906, 80) + " " + " ".join(items[1].split()[:30])
    ]
    texts += [f"{prose(910 + i, 40)}\n{license_line}\n{prose(950 + i, 30)}" for i in range(6)]
    texts += [
        license_line.lower(), license_line, "an only line",
        "short\nshort\nanother line that stands alone\n" + prose(990, 20), prose(991, 20) + "\n" + prose(910, 40)
    ]
    table = [(i, t, ("en", "de")[i % 2], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(
        table, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    kept = plain_clean(plain_firsts(plain_lines(kept)), items)
    assert kept[5] == "" and not {4, 6, 7, 15, 16} & kept.keys() and {3, 8, 9} <= kept.keys()  # 5 lost its one line to 3, and so did 15 and 16 to 9
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for d, t in kept.items():
        ids = enc.encode_ordinary(t)
        want.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
