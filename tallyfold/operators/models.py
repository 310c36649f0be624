"""Model candidates, estimators on Spark ML for one fit over many rows, and cross-fitted probabilities.

Here both boosted families are three binary Spark GBTs with normalised probabilities, of different depth. The
walk-forward fits slices of one series instead, with the softmax boosting of learners.py, leaf-wise and level-wise.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import CLASSES, P
from .labels import time_series_split

FAMILY_RANK = {"baseline": 0, "logistic": 1, "forest": 2, "boosted": 3, "boosted_shallow": 4}
LEAST_TRAIN = 180


@dataclass(frozen=True)
class Candidate:
    family: str
    params: tuple[tuple[str, object], ...] = ()
    delta: float = 0.0
    within_rank: int = 0

    @property
    def complexity_rank(self) -> int:
        return FAMILY_RANK[self.family]

    @property
    def key(self) -> str:
        return f"{self.family}({', '.join(f'{k}={v}' for k, v in self.params)})|delta={self.delta}"


def candidates(grids: dict[str, dict[str, list]], deltas: list[float], only: list[str] | None = None) -> list[Candidate]:
    """All combinations, simplest first; the baseline is always one. Unknown families raise."""
    if unknown := set(grids) - set(FAMILY_RANK):
        raise ValueError(f"unknown model families: {sorted(unknown)}")
    out = [Candidate("baseline")]
    for family, grid in grids.items():
        for i, values in enumerate(product(*grid.values())):
            out += [Candidate(family, tuple(zip(grid, values)), d, i) for d in deltas]
    kept = [c for c in out if only is None or c.family in only or c.family == "baseline"]
    return sorted(kept, key=lambda c: (c.complexity_rank, c.within_rank, -c.delta))


@dataclass
class Fitted:
    """predict(df) adds p_short, p_flat, p_long; a class that was not in the slice has probability 0."""

    predictor: object
    features: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predictor(df)


def class_weight(df: DataFrame, y: str) -> DataFrame:
    """w = n / (K n_c), so that each class counts the same."""
    counts = df.groupBy(y).count().collect()  # three rows
    n, k = sum(r["count"] for r in counts), len(counts)
    w = F.create_map(*(F.lit(v) for r in counts for v in (r[y], n / (k * r["count"]))))
    return df.withColumn("w", w[F.col(y)])


def fit(df: DataFrame, candidate: Candidate, features: list[str], y: str = "label", seed: int = 7) -> Fitted:
    params = dict(candidate.params)
    if candidate.family == "baseline":
        rates = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
        n = sum(rates.values())
        return Fitted(lambda d: d.withColumns({p: F.lit(rates.get(k, 0) / n) for p, k in zip(P, CLASSES)}))
    present = sorted(r[0] for r in df.select(y).distinct().collect())
    assembler = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip")
    rows = assembler.transform(df).withColumn("target", F.element_at(F.create_map(*(F.lit(v) for i, c in enumerate(present) for v in (c, float(i)))), F.col(y)))

    def padded(d: DataFrame, column: F.Column) -> DataFrame:
        at = {c: column[i] for i, c in enumerate(present)}
        return d.withColumns({p: at.get(k, F.lit(0.0)) for p, k in zip(P, CLASSES)}).drop("raw", "scaled", "rawPrediction", "probability", "prediction", "__p")

    if candidate.family == "logistic":
        scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(rows)
        rows = class_weight(scaler.transform(rows), y) if params.get("class_weight") == "balanced" else scaler.transform(rows).withColumn("w", F.lit(1.0))
        m = LogisticRegression(
            featuresCol="scaled", labelCol="target", weightCol="w", family="multinomial", elasticNetParam=0.0,
            standardization=False, regParam=1.0 / (params.get("C", 1.0) * max(df.count(), 1)), maxIter=100
        ).fit(rows)
        return Fitted(
            lambda d: padded(m.transform(scaler.transform(assembler.transform(d))).withColumn("__p", vector_to_array("probability")), F.col("__p")),
            features
        )
    if candidate.family == "forest":
        m = RandomForestClassifier(
            featuresCol="raw", labelCol="target", numTrees=params.get("trees", 300), maxDepth=params.get("depth", 5),
            minInstancesPerNode=params.get("leaf", 20), featureSubsetStrategy="0.5", seed=seed
        ).fit(rows)
        return Fitted(lambda d: padded(m.transform(assembler.transform(d)).withColumn("__p", vector_to_array("probability")), F.col("__p")), features)
    models = []
    for i in range(len(present)):
        d = rows.withColumn("one", (F.col("target") == i).cast("double"))
        models.append(
            GBTClassifier(
                featuresCol="raw", labelCol="one", maxIter=params.get("trees", 20), maxDepth=params.get("depth", 3),
                stepSize=params.get("rate", 0.1), seed=seed
            ).fit(d)
        )

    def predict(d: DataFrame) -> DataFrame:
        d = assembler.transform(d)
        for i, m in enumerate(models):
            d = m.transform(d).withColumn(f"__p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        total = sum((F.col(f"__p{i}") for i in range(len(models))), F.lit(0.0))
        d = d.withColumn("__p", F.array(*(F.try_divide(F.col(f"__p{i}"), total) for i in range(len(models)))))
        return padded(d, F.col("__p")).drop(*(f"__p{i}" for i in range(len(models))))

    return Fitted(predict, features)


def cross_fit(df: DataFrame, n: int, candidate: Candidate, features: list[str], folds: int = 3, y: str = "label", least: int = LEAST_TRAIN) -> DataFrame | None:
    """Out-of-fold probabilities of a slice with pos from 0 to n - 1: each row from a model of earlier rows; folds with too few are skipped."""
    parts = []
    for lo, hi, a, b in time_series_split(n, folds, n // (folds + 1)):
        if hi - lo >= least:
            parts.append(fit(df.where(F.col("pos").between(lo, hi - 1)), candidate, features, y).predict(df.where(F.col("pos").between(a, b - 1))))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
