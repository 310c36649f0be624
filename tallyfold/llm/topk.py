"""Exact top-k by pivot-table elimination.

|d(q,p) - d(x,p)| over many pivots p bounds the distance d(q,x) from below, and, since
2<q,x> = |q|^2 + |x|^2 - d(q,x)^2, the inner product from above. Candidates are evaluated in the order of
that bound until no bound left reaches the k-th best score.

Components are whole numbers. Where all sums of their products stay below 2^51, scores are exact in doubles;
where they do not, scores are computed with whole numbers of any length, and only the bounds are doubles,
widened by their possible error.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns, prepare, scratch_path, written

PIVOTS = 24
#: Vectors from which the pivots are chosen.
PIVOT_SAMPLE = 1024
#: Queries that one pass broadcasts: at most this many vectors.
QUERY_BLOCK = 8192
#: Candidates evaluated at a time, in bound order.
STEP = 64
#: Inner products below EXACT are exact in doubles, and squared distances with them; a decimal of 38 digits holds those below LARGEST.
EXACT, LARGEST = 2.0**51, 1e38
LONG = (-(1 << 63), (1 << 63) - 1)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each next pivot is the vector farthest from those chosen."""
    if not len(sample):
        return sample
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2.0 * x @ pivots.T))


def search(batches, queries: np.ndarray, qid: np.ndarray, pivots: np.ndarray, k: int, exact: bool = True):
    """Per query the k best (score, id) of the rows in the batches: (row, id, vectors); not the query's own row, ties to the smaller id.

    queries and vectors are whole numbers in doubles; with exact, so are the scores, else they are Python's integers.
    """
    qp, qn = to_pivots(queries, pivots), (queries * queries).sum(1)
    far = (pivots * pivots).sum(1).max(initial=0.0)
    best: list[list[tuple]] = [[] for _ in qid]
    whole = None if exact else [[int(v) for v in q] for q in queries]
    for rows, ids, x in batches:
        xp, xn = to_pivots(x, pivots), (x * x).sum(1)
        for i in range(len(qid)):
            # sums of dim rounded squares are off by some dim units in the last place of the largest
            wide, loss = (1e-3, 1e-6) if exact else (1e-3 + 1e-15 * x.shape[1] * (qn[i] + xn), 1e-6 + 4e-8 * np.sqrt(x.shape[1] * (qn[i] + xn + far)))
            low = np.maximum(np.abs(xp - qp[i]).max(1) - loss, 0)
            bound = (qn[i] + xn - low**2) / 2 + wide
            mine = best[i]
            floor = float(mine[-1][0]) if len(mine) == k else -np.inf
            alive = np.flatnonzero((bound >= floor) & (rows != qid[i]))
            alive = alive[np.argsort(-bound[alive], kind="stable")]
            for a in range(0, len(alive), STEP):
                if len(mine) == k and bound[alive[a]] < float(mine[-1][0]):
                    break
                part = alive[a : a + STEP]
                if exact:
                    scores = x[part] @ queries[i]
                    if len(mine) == k:
                        part, scores = part[(hit := scores >= mine[-1][0])], scores[hit]
                    scores = scores.tolist()
                else:
                    scores = [sum(int(v) * w for v, w in zip(x[j].tolist(), whole[i])) for j in part]
                mine = sorted([*mine, *((s, int(ids[j])) for s, j in zip(scores, part))], key=lambda t: (-t[0], t[1]))[:k]
            best[i] = mine
    return best


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`; candidates all other rows of the same length.
    Rows are told apart as such: repeated ids or rows are queries and candidates of their own, and each such
    query has its ranks. Vectors that are null, have a null or non-finite component, no vec_id or no
    component take no part. Ties go to the smaller vec_id. An empty table gives no rows; with fewer candidates
    than k, all are returned. A score beyond a long comes back as the nearest long, ranked by its true value;
    components so large that sums of products may pass 1e38 raise a ValueError.

    One block of queries at a time is on the driver and broadcast; its rows are written before the next one.
    """
    spark = prepare(vectors.sparkSession)
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = ensure_columns(vectors, vec_id="bigint", embedding="array<double>").where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad & (F.size(x) > 0))
    # a double of 2^52 and more is whole already, and floor() would go through a long
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) < 2.0**52, F.floor(v * scale).cast("double")).otherwise(v * scale))
    ints = usable.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), whole.alias("x"), F.size(x).alias("dim"))
    ints = written(ints, "vectors")
    queries = ints.where(F.col("id") % every == 0)
    largest = F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))
    kinds = ints.groupBy("dim").agg(F.count_if(F.col("id") % every == 0).alias("queries"), largest.alias("largest")).where("queries > 0")
    out = scratch_path(spark, "top-k")
    schema = "query_row bigint, query_id bigint, vec_id bigint, score decimal(38,0)"
    spark.createDataFrame([], schema).write.parquet(out)
    for dim, n, most in sorted(tuple(r) for r in kinds.collect()):  # one row for each length of a vector
        if dim * most * most >= LARGEST:
            raise ValueError(f"vectors of length {dim} have components up to {most / scale:g}: sums of their products may pass {LARGEST:g}")
        exact = dim * most * most < EXACT
        sample = ints.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id", "row").limit(PIVOT_SAMPLE).collect()
        pivots = choose_pivots(np.array([r["x"] for r in sample]))
        blocks = -(-2 * n // QUERY_BLOCK)
        for b in range(blocks):
            rows = sorted(queries.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).collect(), key=lambda r: r["row"])
            if not rows:
                continue
            q, qrow, qid = np.array([r["x"] for r in rows]), np.array([r["row"] for r in rows], np.int64), [r["id"] for r in rows]
            held = spark.sparkContext.broadcast((q, qrow, qid, pivots))

            def run(batches, held=held, dim=dim, exact=exact):
                q, qrow, qid, pivots = held.value
                read = ((b.column("row").to_numpy(zero_copy_only=False), b.column("id").to_numpy(zero_copy_only=False), b.column("x")) for b in batches)
                full = ((r, i, v.flatten().to_numpy(zero_copy_only=False).reshape(len(i), dim)) for r, i, v in read if len(i))
                found = [(int(r), i, v, int(s)) for r, i, mine in zip(qrow, qid, search(full, q, qrow, pivots, k, exact)) for s, v in mine]
                if found:
                    r, i, v, s = zip(*found)
                    cols = [*(pa.array(c, pa.int64()) for c in (r, i, v)), pa.array([Decimal(c) for c in s], pa.decimal128(38, 0))]
                    yield pa.RecordBatch.from_arrays(cols, names=["query_row", "query_id", "vec_id", "score"])

            ints.where(F.col("dim") == dim).select("row", "id", "x").mapInArrow(run, schema).write.mode("append").parquet(out)
            held.destroy()
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema(schema).parquet(out).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.greatest(F.lit(LONG[0]), F.least(F.lit(LONG[1]), F.col("score"))).cast("long")
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.rid <> q.rid AND len(q.x) = len(c.x))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
