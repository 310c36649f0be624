"""Language identification by hierarchical discrimination.

Features are counts of hashed byte trigrams of the whole lower-cased text. A linear SVM (one against the
rest, where there are more than two) first chooses the language family; one-versus-one linear SVMs then
separate the languages within it by votes, ties by summed margins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, make_room, prepare

BINS = 4096
#: Labelled rows of one language that the models are fitted on, about; the only sample in this operator.
SAMPLE_PER_LANG = 500
#: Values of lang at most; there is a model for each pair of languages of a family.
LABELS = 128
#: Families of well-known language codes; a code that is not here is in family `other`.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
UND = "und"
_letter = regex.compile(r"\p{L}").search


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.split("-")[0].lower() in langs), "other")


def has_letter(text: str | None) -> bool:
    return bool(text) and _letter(text) is not None


def features(text: str) -> np.ndarray:
    """Square roots of trigram counts, scaled to length 1."""
    b = np.frombuffer(f"  {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    v = np.sqrt(np.bincount(h, minlength=BINS).astype(np.float32))
    return v / np.sqrt((v * v).sum())


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, reg: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """A linear SVM for labels -1 and 1: averaged sub-gradient steps on the hinge loss; then the slope that makes sigmoid(slope * margin) fit best."""
    rng, n = np.random.default_rng(seed), len(x)
    x = np.hstack([x, np.ones((n, 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * n
    w, total, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // 32)):
            t += 1
            xb, yb = x[part], y[part]
            wrong = (yb * (xb @ w) < 1) * yb * weight[part]
            w = w * (1 - 1 / (t + 10)) + (wrong @ xb) / (len(part) * reg * (t + 10))
            total += w
    w = total / max(t, 1)
    z, s = y * (x @ w), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(s * z, -30, 30)))
        s = min(max(s + ((p - 1 / (n + 2)) * z).mean() / max((p * (1 - p) * z * z).mean(), 1e-9), 0.05), 20.0)  # a target of just under 1, as in Platt scaling
    return w * s, s


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS + 1), np.float32))
    rows: dict[tuple, int] = field(default_factory=dict)

    def _add(self, key: tuple, x: np.ndarray, y: np.ndarray) -> None:
        w, _ = fit_svm(x, y)
        self.rows[key] = len(self.weights)
        self.weights = np.vstack([self.weights, w[None].astype(np.float32)])

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Model:
        """x: features of a sample; langs: its labels."""
        m, of = cls(), np.array([family(v) for v in langs])
        langs_ = np.array(langs)
        m.families = sorted(set(of.tolist()))
        for f in m.families:
            m.members[f] = sorted(set(langs_[of == f].tolist()))
            if len(m.families) > 2 or len(m.families) == 2 and f == m.families[0]:
                m._add(("family", f), x, np.where(of == f, 1.0, -1.0))
            for a, b in combinations(m.members[f], 2):
                pick = (langs_ == a) | (langs_ == b)
                m._add((f, a, b), x[pick], np.where(langs_[pick] == a, 1.0, -1.0))
        return m

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """The language of one text's features, and a score from 0 to 1."""
        if not self.families:
            return UND, 0.0
        z = self.weights[:, :-1] @ v + self.weights[:, -1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if len(self.families) == 1:
            f, score = self.families[0], 1.0
        elif len(self.families) == 2:
            q = float(p[self.rows["family", self.families[0]]])
            f, score = (self.families[0], q) if q >= 0.5 else (self.families[1], 1 - q)
        else:
            q = np.array([p[self.rows["family", f]] for f in self.families])
            f, score = self.families[int(q.argmax())], float(q.max() / max(q.sum(), 1e-12))
        votes = dict.fromkeys(self.members[f], (0, 0.0))
        for a, b in combinations(self.members[f], 2):
            q = float(p[self.rows[f, a, b]])
            votes[a] = (votes[a][0] + (q >= 0.5), votes[a][1] + q)
            votes[b] = (votes[b][0] + (q < 0.5), votes[b][1] + 1 - q)
        best = max(self.members[f], key=lambda k: (votes[k], k))
        rivals = len(self.members[f]) - 1
        return best, score * (votes[best][1] / rivals if rivals else 1.0)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE_PER_LANG) -> Model:
    """Learns from rows with a text that has letters, a lang and a doc_id that is not held out.

    About `sample` rows of each language are drawn by a hash of id and text; repeated rows are drawn together.
    More than LABELS values of lang raise a ValueError: such a column holds no languages. No usable row, or an
    empty table: a model that knows no language.
    """
    spark = prepare(docs.sparkSession)
    usable = ensure_columns(docs, doc_id="bigint", text="string", lang="string").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    )
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().limit(LABELS + 1).collect()}
    if not counts:
        return Model()
    if len(counts) > LABELS:
        raise ValueError(f"lang has more than {LABELS} values")
    keep = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.2 * sample / n))))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    picked = usable.where(draw < keep[F.col("lang")]).select("text", "lang", F.xxhash64("doc_id", "text").alias("order"))

    def vectors(batches):
        for b in batches:
            rows = [features(t).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column("lang"), b.column("order")], names=["v", "lang", "order"])

    rows = sorted(picked.mapInArrow(vectors, "v binary, lang string, order bigint").collect(), key=lambda r: (r["lang"], r["order"], r["v"]))
    x = np.frombuffer(b"".join(r["v"] for r in rows), np.float16).reshape(-1, BINS).astype(np.float32) if rows else np.zeros((0, BINS), np.float32)
    return Model.fit(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs and held_out, lang_pred, score.

    lang_pred is `und` with score 0 if the text is null or has no letter, or if nothing could be learned.
    Predictions depend on the whole text alone, of any length, so repeated texts get the same one. Ties of
    votes and margins go to the later name. Every row comes back once; an empty table gives no rows; a row
    without a doc_id is not held out. Other columns stay; clashing ones as <name>_in.
    """
    spark = prepare(docs.sparkSession)
    model = fit(docs) if model is None else model
    held = spark.sparkContext.broadcast(model)  # BINS numbers for each pair of languages
    docs = make_room(docs, "held_out", "lang_pred", "score", "__p")

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        m = held.value
        found = [m.predict(features(t)) if has_letter(t) else (UND, 0.0) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    doc_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("bigint")
    return docs.withColumn("__p", predict("text")).select(
        *docs.columns, held_out(doc_id).alias("held_out"), F.col("__p.lang_pred").alias("lang_pred"),
        F.col("__p.score").alias("score")
    )


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
