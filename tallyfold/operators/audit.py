"""Comparison of runs and vintages, contracts, and the registry of experiments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The experiment registry: all text, appended to, never rewritten.
REGISTRY_FIELDS = (
    "experiment_id", "kind", "status", "created", "commit", "config_sha256", "overlay", "specification", "sample_start", "sample_end", "n_sessions", "n_features", "model_families",
    "n_candidates", "cost_bps", "seed", "net_sharpe", "ann_mean_excess", "participation", "paired_difference", "ci_low", "ci_high", "counts_toward_budget", "exclusion_reason", "notes",
)
REGISTRY_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in REGISTRY_FIELDS])


def _pairs(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    left = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(1).alias("__a"))
    right = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(1).alias("__b"))
    joined = left.join(right, keys, "full")
    pairs = F.array(
        *(F.struct(F.lit(c).alias("column_name"), F.col(f"a_{c}").cast("double").alias("x"), F.col(f"b_{c}").cast("double").alias("y")) for c in columns)
    )
    return joined.select(*keys, (F.col("__a").isNull() | F.col("__b").isNull()).alias("one_sided"), F.inline(pairs))


def run_diff(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """For each column: rows on one side only, rows with both values, rows that differ by more than the tolerance or
    are missing on one side, largest absolute and relative difference.
    """
    d = F.abs(F.col("x") - F.col("y"))
    differs = F.coalesce(d > tolerance, F.col("x").isNull() != F.col("y").isNull())
    return _pairs(a, b, keys, columns).groupBy("column_name").agg(
        F.count_if("one_sided").alias("n_one_sided"), F.count_if(
            F.col("x").isNotNull() & F.col("y").isNotNull()
        ).alias("n_both"), F.count_if(differs & ~F.col("one_sided")).alias("n_different"),
        F.coalesce(F.max(d), F.lit(0.0)).alias("max_abs"), F.coalesce(F.max(F.try_divide(d, F.abs("x"))), F.lit(0.0)).alias("max_rel"),
    )


def vintage_diff(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], by: Column, name: str, tolerance: float = 0.0) -> DataFrame:
    """run_diff of two vintages for each value of `by` (of the keys) and column; rows on one side only count apart."""
    d = F.abs(F.col("x") - F.col("y"))
    return _pairs(a, b, keys, columns).withColumn(name, by).groupBy(name, "column_name").agg(
        F.count_if("one_sided").alias("n_one_sided"), F.count_if(
            F.coalesce(d > tolerance, F.col("x").isNull() != F.col("y").isNull()) & ~F.col("one_sided")
        ).alias("n_cells"),
        F.coalesce(F.max(d), F.lit(0.0)).alias("max_abs"), F.coalesce(F.max(F.try_divide(d, F.abs("x"))), F.lit(0.0)).alias("max_rel"),
    )


def text_equal(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row: for each column whether all rows have equal text on both sides."""
    j = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in columns)).join(b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in columns)), keys, "full")
    return j.agg(*(F.bool_and(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns))


def expand_ids(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """Ids of lists such as `E1-E4, E9`: ranges become all their members."""
    part = df.select(F.explode(F.split(column, r"\s*,\s*")).alias("part"))
    lo, hi = F.regexp_extract("part", r"^[A-Za-z]*(\d+)", 1), F.regexp_extract("part", r"-[A-Za-z]*(\d+)$", 1)
    prefix = F.regexp_extract("part", r"^([A-Za-z]*)", 1)
    n = lo.try_cast("int")
    return part.where(n.isNotNull()).select(
        F.explode(F.transform(F.sequence(n, F.greatest(F.coalesce(hi.try_cast("int"), n), n)), lambda i: F.concat(prefix, i.cast("string")))).alias(name)
    ).distinct()


def missing_ids(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """side, id: ids on one side only."""
    a, b = expected.select(key).distinct(), present.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("missing").alias("side"), key).unionByName(
        b.join(a, key, "left_anti").select(F.lit("unexpected").alias("side"), key)
    )


def text_lengths(df: DataFrame, limit: int = 200) -> DataFrame:
    """For each text column its longest value and the number of values over the limit."""
    columns = [c for c, k in df.dtypes if k == "string"]
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.length(c).cast("long").alias("n")) for c in columns))))
    return long.groupBy("column_name").agg(F.max("n").alias("max_length"), F.count_if(F.col("n") > limit).alias("n_over"))


def forbidden_columns(df: DataFrame, names: set[str]) -> list[str]:
    return sorted(c for c in df.columns if c.lower() in names)


def missing_columns(df: DataFrame, declared: list[str]) -> list[str]:
    return [c for c in declared if c not in df.columns]


def as_registry(rows: DataFrame) -> DataFrame:
    """Rows with exactly the registry's fields: others are left out, absent ones are empty text."""
    return rows.select(*(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in rows.columns else F.lit("").alias(f) for f in REGISTRY_FIELDS))


def append_registry(rows: DataFrame, path: str) -> None:
    as_registry(rows).write.mode("append").parquet(path)


def registry_budget(registry: DataFrame) -> DataFrame:
    """counted and excluded experiments."""
    return registry.agg(
        F.count_if(F.col("counts_toward_budget") == "yes").alias("n_counted"),
        F.count_if(F.coalesce(F.col("counts_toward_budget"), F.lit("")) != "yes").alias("n_excluded")
    )


def natural_order(c: str) -> list[Column]:
    """E2 before E10."""
    return [F.regexp_extract(c, r"(\d+)", 1).try_cast("int").asc_nulls_last(), F.col(c).asc()]


def all_equal(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


HASH_STATES = ("unchanged", "changed", "missing", "new")


def hash_states(recorded: dict[str, str], found: dict[str, str]) -> dict[str, str]:
    """The state of each file, by recorded and found digests."""
    return {
        k: "new" if k not in recorded else "missing" if k not in found else "unchanged" if recorded[k] == found[k] else "changed" for k in sorted({*recorded, *found})
    }


def registry_markdown(features) -> str:
    """Documentation of a feature registry."""
    lines = []
    for g in features.groups:
        lines += [f"## {g} ({len(features.names(g))})", "", "| feature | formula | notes |", "|-|-|-|"]
        lines += [f"| {f.name} | {f.formula} | {f.notes} |" for f in features.features if f.group == g] + [""]
    return "\n".join(lines)
