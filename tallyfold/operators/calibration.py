"""Scores of class probabilities, and calibrators fitted one class against the rest."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = (-1, 0, 1)
P = ("p_short", "p_flat", "p_long")
TINY, LEAST, LEAST_EACH = 1e-9, 200, 30
#: Ten equal bins as doubles come out of even spacing.
EDGES = tuple(i * 0.1 for i in range(10)) + (1.0,)


def brier(y: str, p: tuple[str, str, str] = P) -> Column:
    """Squared error summed over the three classes, from 0 to 2."""
    return sum(((F.col(c) - (F.col(y) == k).cast("double")) ** 2 for c, k in zip(p, CLASSES)), F.lit(0.0))


def brier_skill(y: str, rates: tuple[Column, Column, Column], p: tuple[str, str, str] = P) -> Column:
    """1 - B / B of fixed rates; NULL without rows or where the rates are perfect."""
    reference = sum(((r - (F.col(y) == k).cast("double")) ** 2 for r, k in zip(rates, CLASSES)), F.lit(0.0))
    return 1.0 - F.try_divide(F.avg(brier(y, p)), F.avg(reference))


def bin_of(p: Column) -> Column:
    """The bin [lo, hi) by comparison with the edges; 1 is in the last."""
    return F.least(sum(((p >= e).cast("int") for e in EDGES[1:]), F.lit(0)), F.lit(9))


def reliability(spark: SparkSession, df: DataFrame, y: str, families: dict[str, tuple[str, str, str]]) -> DataFrame:
    """class_label, probabilities, bin, n, mean_predicted, realised_frequency: all bins, also those of no row."""
    parts = [
        F.struct(F.lit(k).alias("class_label"), F.lit(name).alias("probabilities"), F.col(c).alias("p"), (F.col(y) == k).cast("double").alias("hit")) for name,
        p in families.items() for c, k in zip(p, CLASSES)
    ]
    long = df.select(F.inline(F.array(*parts))).where("p IS NOT NULL").withColumn("bin", bin_of(F.col("p")))
    seen = long.groupBy("class_label", "probabilities", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("hit").alias("realised_frequency")
    )
    spine = spark.createDataFrame([(k, n, b) for k in CLASSES for n in families for b in range(10)], "class_label int, probabilities string, bin int")
    return F.broadcast(spine).join(seen, ["class_label", "probabilities", "bin"], "left").na.fill(0, ["n"])  # 30 rows a family


def base_rates(y: str) -> list[Column]:
    return [F.avg((F.col(y) == k).cast("double")).alias(f"rate_{n}") for k, n in zip(CLASSES, ("short", "flat", "long"))]


def viable(df: DataFrame, y: str) -> bool:
    """Enough rows for a calibrator: 200 in all and 30 of each class."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(y) == k).alias(f"c{i}") for i, k in enumerate(CLASSES))).first()
    return row["n"] >= LEAST and min(row[f"c{i}"] for i in range(3)) >= LEAST_EACH


def normalise(columns: list[Column], p: tuple[str, str, str] = P) -> list[Column]:
    """Scaled to a sum of 1; a third each where the sum is 0."""
    total = columns[0] + columns[1] + columns[2]
    return [F.when(total > 0, c / F.when(total > 0, total)).otherwise(1 / 3).alias(n) for c, n in zip(columns, p)]


def clipped(c: str) -> Column:
    return F.least(F.greatest(F.col(c), F.lit(TINY)), F.lit(1 - TINY))


def logit(c: str) -> Column:
    return F.log(clipped(c) / (1 - clipped(c)))


class Sigmoid:
    """A logistic curve on the logit of each class against the rest; a class that is all or nothing passes through."""

    def fit(self, df: DataFrame, y: str, p: tuple[str, str, str] = P) -> Sigmoid:
        n = df.count()
        self.p, self.curves = p, {}
        for c, k in zip(p, CLASSES):
            d = df.select(logit(c).alias("x"), (F.col(y) == k).cast("double").alias("label"))
            if d.agg(F.countDistinct("label")).first()[0] == 2:
                d = VectorAssembler(inputCols=["x"], outputCol="features").transform(d)
                m = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False).fit(d)
                self.curves[c] = (float(m.coefficients[0]), float(m.intercept))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in self.p:
            a = self.curves.get(c)
            out.append(clipped(c) if a is None else 1 / (1 + F.exp(-(F.lit(a[0]) * logit(c) + F.lit(a[1])))))
        rest = [x for x in df.columns if x not in self.p]
        return df.select(*rest, *normalise(out, self.p))


class Isotonic:
    """A rising step-wise linear curve of each class against the rest, constant outside what it has seen."""

    def fit(self, df: DataFrame, y: str, p: tuple[str, str, str] = P) -> Isotonic:
        self.p, self.curves = p, {}
        for c, k in zip(p, CLASSES):
            d = df.select(F.col(c).alias("x"), (F.col(y) == k).cast("double").alias("label"))
            if d.agg(F.countDistinct("label")).first()[0] == 2:
                self.curves[c] = IsotonicRegression(featuresCol="x", labelCol="label", predictionCol=f"__{c}").fit(d)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rest = [x for x in df.columns if x not in self.p]
        for c, m in self.curves.items():
            df = m.transform(df.withColumn("x", F.col(c))).drop("x")
        return df.select(
            *rest,
            *normalise([F.least(F.greatest(F.col(f"__{c}"), F.lit(0.0)), F.lit(1.0)) if c in self.curves else clipped(c) for c in self.p], self.p)
        )


CALIBRATORS = {"sigmoid": Sigmoid, "isotonic": Isotonic}


def calibrator(name: str):
    if name not in CALIBRATORS:
        raise ValueError(f"unknown calibrator {name!r}; known: {sorted(CALIBRATORS)}")
    return CALIBRATORS[name]()


def array_of(vector: str) -> Column:
    return vector_to_array(vector)
